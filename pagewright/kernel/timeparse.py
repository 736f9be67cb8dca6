"""Reading times in many notations: every valid reading of a value, without choosing between them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names of the languages in the corpus, full names and the abbreviations of English.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
MONTH = {name: i + 1 for names in MONTHS.values() for i, name in enumerate(names.split())} | {"sept": 9}

# Units of relative times in seconds, by language.
UNITS = {
    "second": 1, "sekunde": 1, "sekunden": 1, "seconde": 1, "segundo": 1, "secondo": 1, "secondi": 1, "seconden": 1, "секунда": 1, "секунды": 1, "секунд": 1, "секунду": 1, "秒": 1,
    "minute": 60, "min": 60, "minuten": 60, "minuto": 60, "minuti": 60, "минута": 60, "минуты": 60, "минут": 60, "минуту": 60, "分": 60, "分钟": 60,
    "hour": 3600, "stunde": 3600, "stunden": 3600, "heure": 3600, "hora": 3600, "ora": 3600, "ore": 3600, "uur": 3600, "час": 3600, "часа": 3600, "часов": 3600, "時間": 3600, "小时": 3600,
    "day": 86400, "tag": 86400, "tagen": 86400, "jour": 86400, "día": 86400, "dia": 86400, "giorno": 86400, "giorni": 86400, "dag": 86400, "dagen": 86400, "день": 86400, "дня": 86400, "дней": 86400, "日": 86400, "天": 86400,
    "week": 604800, "woche": 604800, "wochen": 604800, "semaine": 604800, "semana": 604800, "settimana": 604800, "settimane": 604800, "weken": 604800, "неделю": 604800, "недели": 604800, "недель": 604800, "週間": 604800, "周": 604800,
}

_TIME = r"(?P<H>\d{1,2})(?::|h)(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_AMPM = r"(?:\s*(?P<ap>[aApP])\.?[mM]\.?)?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})(?:\[[A-Za-z_+\-/0-9]+\])?)?"
_TAIL = rf"(?:(?:,|T|\s|at|à|um|a las|às|в|alle|om)*\s*{_TIME}{_AMPM}(?:\s*Uhr)?{_ZONE})?"
_WEEKDAY = r"(?:[^\W\d]{2,12}\.?,?\s+)?"
_NAME = r"(?P<mon>[^\W\d_]{3,12})\.?"

#: (name, pattern, order of three numbers or None)
FORMATS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}}){_TAIL}"), None),
    ("basic", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?P<z>Z|[+-]\d{2}:?\d{2})?"), None),
    ("pdf", re.compile(r"D:(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?P<z>Z|[+-]\d{2}'\d{2})?'?"), None),
    ("epoch", re.compile(r"(?P<n>\d{9,10}|\d{12,13}|\d{15,16})"), None),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}}){_TAIL}"), None),
    ("numbers", re.compile(rf"(?P<a>\d{{1,2}})[/.\-](?P<b>\d{{1,2}})[/.\-](?P<c>\d{{4}}|\d{{2}}){_TAIL}"), "abc"),
    ("cjk", re.compile(r"(?P<y>\d{4})[年년]\s*(?P<m>\d{1,2})[月월]\s*(?P<d>\d{1,2})[日일](?:\s*(?P<H>\d{1,2})[:時时](?P<M>\d{2})(?:[:分](?P<S>\d{2})?秒?)?)?"), None),
    ("day name year", re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:er|\.|º)?[\s\-]+(?:de\s+)?{_NAME}[\s\-,]+(?:de\s+)?(?P<y>\d{{4}}|\d{{2}})(?:\s*г\.)?{_TAIL}"), None),
    ("name day year", re.compile(rf"{_WEEKDAY}{_NAME}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}"), None),
    ("asctime", re.compile(rf"{_WEEKDAY}{_NAME}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})"), None),
]

_RELATIVE = [
    re.compile(r"(?P<n>\d+)\s+(?P<u>[^\W\d_]+)\s+(?:ago|fa|geleden|atrás|назад)", re.I),
    re.compile(r"(?:il y a|vor|hace|há)\s+(?P<n>\d+)\s+(?P<u>[^\W\d_]+)", re.I),
    re.compile(r"(?P<n>\d+)\s*(?P<u>秒|分钟|分|小时|時間|天|日|週間|周)(?:前)", re.I),
]

_EPOCH = datetime(1970, 1, 1)


def readings(value: str | None, offsets: dict[str, int]) -> list[tuple[str, int, int | None]]:
    """Every valid reading of `value` as (notation, milliseconds, offset minutes).

    The notation is a format's name, followed by `/DMY`, `/MDY` or `/YMD` where the format leaves the order of three numbers open, or by the
    unit of a bare number. milliseconds are local if the offset is None, else UTC. A relative time has the notation `relative`, and its
    milliseconds are the (negative) distance from the time of fetching.
    """
    if not value or len(value) > 120:  # no notation is longer; a longer value names no single instant
        return []
    value = value.strip()
    if not any(map(str.isdigit, value)):
        return []
    for pattern in _RELATIVE:
        if m := pattern.fullmatch(value):
            unit = m["u"].lower()
            seconds = UNITS.get(unit) or UNITS.get(unit.removesuffix("s"))
            return [("relative", -1000 * seconds * int(m["n"]), 0)] if seconds else []
    found = []
    for name, pattern, order in FORMATS:
        m = pattern.fullmatch(value)
        if not m:
            continue
        g = m.groupdict()
        if name == "epoch":
            n = g["n"]
            unit, ms = ("s", int(n) * 1000) if len(n) <= 10 else ("ms", int(n)) if len(n) <= 13 else ("us", int(n) // 1000)
            found.append((f"epoch/{unit}", ms, 0))
            continue
        clock = _clock(g)
        offset = _offset(g.get("z"), offsets)
        if clock is None or offset is False:
            continue
        if order:
            a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
            dates = {"/DMY": (c, b, a), "/MDY": (c, a, b)} if len(g["c"]) == 4 else {"/DMY": (c, b, a), "/MDY": (c, a, b), "/YMD": (a, b, c)}
        else:
            month = MONTH.get((g.get("mon") or "").lower()) if "mon" in g else int(g["m"])
            dates = {"": (int(g["y"]), month, int(g["d"]))} if month else {}
        for which, (y, mo, d) in dates.items():
            try:
                day = datetime(y + 2000 if y < 100 else y, mo, d)
            except ValueError:
                continue
            ms = (day - _EPOCH).days * 86_400_000 + clock
            found.append((name + which, ms if offset is None else ms - offset * 60_000, offset))
    return found


def _clock(g: dict) -> int | None:
    """Milliseconds since midnight; None if the time can't be."""
    if not g.get("H"):
        return 0
    hour, minute, second = int(g["H"]), int(g["M"] or 0), int(g.get("S") or 0)
    if half := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half in "pP")
    if hour > 23 or minute > 59 or second > 59:
        return None
    return ((hour * 60 + minute) * 60 + second) * 1000 + int((g.get("f") or "0").ljust(3, "0")[:3])


def _offset(zone: str | None, offsets: dict[str, int]) -> int | None | bool:
    """Offset in minutes, None without a zone, False for one that isn't known."""
    if not zone:
        return None
    if zone == "Z":
        return 0
    if zone[0] in "+-":
        digits = re.sub(r"\D", "", zone).ljust(4, "0")
        hours, minutes = int(digits[:2]), int(digits[2:])
        return (1 if zone[0] == "+" else -1) * (hours * 60 + minutes) if hours <= 18 and minutes < 60 else False
    return offsets.get(zone, False)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def local_to_utc(ms: int, zone_name: str | None) -> int | None:
    """UTC milliseconds of a local time; None where it occurs never or twice, or the zone isn't known."""
    zone = _zone(zone_name) if zone_name else None
    if zone is None:
        return None
    local = _EPOCH + timedelta(milliseconds=ms)
    early, late = local.replace(tzinfo=zone, fold=0).utcoffset(), local.replace(tzinfo=zone, fold=1).utcoffset()
    if early != late:
        return None
    utc = ms - int(early.total_seconds() * 1000)
    back = datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=utc)
    return utc if back.astimezone(zone).replace(tzinfo=None) == local else None
