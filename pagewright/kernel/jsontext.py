"""JSON that isn't quite: control characters, odd literals, text around it, an abrupt end; events and offsets of its nodes."""

from __future__ import annotations

from dataclasses import dataclass, field


class JsonError(ValueError):
    """The text is no JSON under the options given."""


@dataclass
class Options:
    control: bool = False  # raw control characters in strings
    literal_case: bool = False  # TRUE, Null
    contaminated: bool = False  # text in front of the first container
    abrupt: bool = False  # an end within a node
    swallow: bool = False  # keep what was read before an error


@dataclass
class Reader:
    """Reads one document; events are (kind, path, value, start, end) with positions in characters."""

    text: str
    options: Options = field(default_factory=Options)
    at: int = 0
    events: list[tuple] = field(default_factory=list)

    def read(self) -> object:
        if self.options.contaminated:
            starts = [i for i in (self.text.find("{"), self.text.find("[")) if i >= 0]
            self.at = min(starts) if starts else len(self.text)
        self.blanks()
        try:
            value = self.value(())
        except JsonError:
            if self.options.swallow:
                return self.partial
            raise
        self.blanks()
        if self.at < len(self.text) and not self.options.contaminated:
            if self.options.swallow:
                return value
            raise JsonError(f"unexpected {self.text[self.at]!r} at {self.at}")
        return value

    partial: object = None

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in "\t\r\n ":
            self.at += 1

    def ended(self) -> bool:
        if self.at < len(self.text):
            return False
        if not self.options.abrupt:
            raise JsonError("unexpected end")
        return True

    def value(self, path: tuple) -> object:
        if self.ended():
            return None
        start, c = self.at, self.text[self.at]
        if c == "{":
            out = self.object(path)
        elif c == "[":
            out = self.array(path)
        elif c == '"':
            out = self.string()
        elif c in "-0123456789":
            out = self.number()
        else:
            out = self.literal()
        self.events.append(("node", path, None if isinstance(out, dict | list) else out, start, self.at))
        return out

    def object(self, path: tuple) -> dict:
        out: dict = {}
        if not path:
            self.partial = out
        self.at += 1
        first = True
        while True:
            self.blanks()
            if self.ended():
                return out
            if self.text[self.at] == "}" and (first or self.text[self.at - 1] != ","):
                self.at += 1
                return out
            if not first:
                if self.text[self.at] != ",":
                    raise JsonError(f"expected , at {self.at}")
                self.at += 1
                self.blanks()
                if self.ended():
                    return out
            first = False
            if self.text[self.at] != '"':
                raise JsonError(f"expected a key at {self.at}")
            key = self.string()
            self.blanks()
            if self.ended():
                return out
            if self.text[self.at] != ":":
                raise JsonError(f"expected : at {self.at}")
            self.at += 1
            self.blanks()
            if self.ended():
                return out
            out[key] = self.value((*path, key))

    def array(self, path: tuple) -> list:
        out: list = []
        if not path:
            self.partial = out
        self.at += 1
        while True:
            self.blanks()
            if self.ended():
                return out
            if self.text[self.at] == "]" and not out:
                self.at += 1
                return out
            if out:
                if self.text[self.at] == "]":
                    self.at += 1
                    return out
                if self.text[self.at] != ",":
                    raise JsonError(f"expected , at {self.at}")
                self.at += 1
                self.blanks()
                if self.ended():
                    return out
            out.append(self.value((*path, len(out))))

    def string(self) -> str:
        escapes = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
        self.at += 1
        out: list[str] = []
        while not self.ended():
            c = self.text[self.at]
            self.at += 1
            if c == '"':
                break
            if c == "\\":
                if self.ended():
                    break
                e = self.text[self.at]
                self.at += 1
                if e == "u":
                    digits = self.text[self.at : self.at + 4]
                    try:
                        out.append(chr(int(digits, 16)))
                    except ValueError as error:
                        if self.at + 4 >= len(self.text) and self.options.abrupt:
                            self.at = len(self.text)
                            break
                        raise JsonError(f"bad escape at {self.at}") from error
                    self.at += 4
                elif e in escapes:
                    out.append(escapes[e])
                else:
                    raise JsonError(f"bad escape at {self.at}")
            elif c < " " and not self.options.control:
                raise JsonError(f"control character at {self.at - 1}")
            else:
                out.append(c)
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def number(self) -> int | float:
        import re

        m = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?").match(self.text, self.at)
        rest = self.text[m.end() : m.end() + 1] if m else ""
        if not m or rest in tuple("0123456789.eE+-") and rest:
            raise JsonError(f"bad number at {self.at}")
        self.at = m.end()
        return float(m[0]) if set(m[0]) & set(".eE") else int(m[0])

    def literal(self) -> object:
        for word, value in (("true", True), ("false", False), ("null", None)):
            part = self.text[self.at : self.at + len(word)]
            same = part.lower() == word if self.options.literal_case else part == word
            if same:
                self.at += len(word)
                return value
            if self.options.abrupt and part and self.at + len(part) == len(self.text) and word.startswith(part):
                self.at = len(self.text)
                return value
        raise JsonError(f"unexpected {self.text[self.at]!r} at {self.at}")


def parse_tolerant(text: str, **options: bool) -> object:
    return Reader(text, Options(**options)).read()


def focus(value: object, path: str) -> object:
    """The part at a path such as `a.b[0].c`; None where there is none."""
    import re

    for key, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        try:
            value = value[int(index)] if index else value[int(key)] if isinstance(value, list) else value[key]
        except (KeyError, IndexError, TypeError, ValueError):
            return None
    return value


def offsets(text: str, path: tuple, **options: bool) -> tuple[int, int, int, int] | None:
    """(start, end) of a node in characters, then in bytes."""
    reader = Reader(text, Options(**options))
    reader.read()
    for _, at, _, start, end in reader.events:
        if at == path:
            return start, end, len(text[:start].encode()), len(text[:end].encode())
    return None


def escape_newlines(text: str) -> str:
    """Raw line breaks within strings, escaped."""
    out, inside, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif c == "\\":
            skip = inside
        elif c == '"':
            inside = not inside
        elif inside and c in "\n\r":
            c = "\\n" if c == "\n" else "\\r"
        out.append(c)
    return "".join(out)


class EventStream:
    """Server-sent events put together from chunks of any size."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, chunk: str) -> list[dict]:
        held = self.rest + chunk
        if held.endswith("\r"):  # the line feed may come with the next chunk
            held, tail = held[:-1], "\r"
        else:
            tail = ""
        blocks = held.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
        self.rest = blocks.pop() + tail
        return [e for b in blocks if (e := self.event(b))]

    @staticmethod
    def event(block: str) -> dict | None:
        out: dict = {}
        for line in block.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                out["data"] = f"{out['data']}\n{value}" if "data" in out else value
            elif name in ("event", "id"):
                out[name] = value
            elif name == "retry" and value.isdigit():
                out["retry"] = int(value)
        return out or None
