"""Record text: reading, writing, repair. Each row of a column is one record."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import values
from .values import Record, RecordError


@dataclass(frozen=True)
class Options:
    """How text is read. strict: no comments, semicolons, duplicates or unsorted fields. normalize: bare 0, 1, true,
    false, yes and no are booleans."""

    strict: bool = False
    normalize: bool = True
    lenient: bool = False
    validate_checksums: bool = False
    require_checksums: bool = False
    max_depth: int | None = None
    max_fields: int | None = None
    max_string: int | None = None
    max_items: int | None = None

    @staticmethod
    def profile(name: str) -> Options:
        return {"loose": Options(), "standard": Options(normalize=False), "strict": Options(strict=True, normalize=False, validate_checksums=True)}[name]


HINTS = {"i", "f", "b", "s", "sa", "ia", "fa", "ba", "r", "ra", "v", "qv"}
_TOKEN = re.compile(r'[ \t\r]+|(?P<newline>\n)|(?P<field>F(?=[0-9]))|(?P<number>-[0-9.]*|[0-9][0-9.]*)|(?P<word>[A-Za-z_.][A-Za-z0-9_.-]*)|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<hint>:[a-z]*)|(?P<mark>[=;,\[\]{}#])', re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_UNESCAPED = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t"}
_BOOLS = {"true": True, "yes": True, "false": False, "no": False}


class Reader:
    """Recursive descent over one record's tokens."""

    def __init__(self, text: str, options: Options):
        self.text, self.o, self.at, self.depth = text, options, 0, 0
        self.kind, self.token, self.start = "", "", 0
        self.next()

    def fail(self, kind: str, msg: str, fid: int | None = None) -> RecordError:
        before = self.text[: self.start]
        return RecordError(kind, msg, fid, before.count("\n") + 1, self.start - before.rfind("\n"))

    def next(self) -> None:
        while True:
            self.start = self.at
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise self.fail("UnterminatedString", "unterminated string") if self.text[self.at] == '"' else self.fail("UnexpectedToken", f"unexpected {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup:
                self.kind, self.token = m.lastgroup, m[0]
                if self.kind == "mark":
                    self.kind = m[0]
                elif self.kind == "quoted":
                    for e in _ESCAPE.findall(m[0][1:-1]):
                        if e not in _UNESCAPED:
                            raise self.fail("InvalidEscapeSequence", f"\\{e}")
                    self.token = _ESCAPE.sub(lambda e: _UNESCAPED[e[1]], m[0][1:-1])
                return

    def take(self, kind: str) -> str:
        if self.kind != kind:
            raise self.fail("UnexpectedToken", f"expected {kind}, found {self.kind} {self.token!r}")
        token = self.token
        self.next()
        return token

    def blank(self) -> None:
        """Newlines, and comment lines, which run to the line's end whatever they hold."""
        while self.kind in ("newline", "#"):
            if self.kind == "#":
                end = self.text.find("\n", self.start)
                self.at = len(self.text) if end < 0 else end
            self.next()

    def record(self) -> Record:
        if self.o.strict and re.search(r"(?m)^\s*#", self.text):
            raise RecordError("StrictModeViolation", "comment", None, 1, 1)
        out: Record = []
        self.blank()
        while self.kind != "end":
            out.append(self.field(out))
            if self.kind == ";":
                if self.o.strict:
                    raise self.fail("StrictModeViolation", "semicolon")
                self.next()
            elif self.kind == "newline":
                self.blank()
            elif self.kind != "end":
                raise self.fail("UnexpectedToken", f"after a field: {self.token!r}")
        if self.o.strict and any(b[0] < a[0] for a, b in zip(out, out[1:], strict=False)):
            raise self.fail("StrictModeViolation", "fields are not sorted")
        self.limits(out)
        return out

    def field(self, before: Record) -> tuple[int, str, object]:
        self.take("field")
        if self.kind != "number" or not self.token.isdigit() or int(self.token) > 65535:
            raise self.fail("InvalidFieldId", self.token)
        fid = int(self.take("number"))
        hint = None
        if self.kind == "hint":
            hint = self.take("hint")[1:]
            if hint not in HINTS:
                raise self.fail("InvalidTypeHint", hint, fid) if hint else self.fail("UnexpectedToken", ":")
        self.take("=")
        tag, value = self.value(hint)
        if hint and hint != tag:
            raise self.fail("TypeHintMismatch", f"{hint} is {tag}", fid)
        if self.kind == "#":
            self.checksum(fid, hint, tag, value)
        elif self.o.require_checksums:
            raise self.fail("ChecksumMismatch", "checksum required", fid)
        if self.o.strict and any(f[0] == fid for f in before):
            raise self.fail("DuplicateFieldId", str(fid), fid)
        return fid, tag, value

    def checksum(self, fid: int, hint: str | None, tag: str, value: object) -> None:
        digits = re.compile(r"[ \t]*([A-Za-z0-9_.-]*)").match(self.text, self.at)
        if not re.fullmatch(r"(?:0[xX])?[0-9A-Fa-f]{8}", digits[1]):
            raise self.fail("InvalidChecksum", digits[1], fid)
        self.at = digits.end()
        self.next()
        if self.o.validate_checksums and int(digits[1][-8:], 16) != (found := values.checksum(fid, hint, value, tag)):
            raise self.fail("ChecksumMismatch", f"{digits[1]} is not {found:08X}", fid)

    def number(self, integer: bool = False) -> int | float:
        token = self.take("number")
        try:
            if "." in token and not integer:
                return float(token)
            n = int(token)
        except ValueError:
            raise self.fail("InvalidValue", token) from None
        if not -(2**63) <= n < 2**63:
            raise self.fail("InvalidValue", token)
        return n

    def value(self, hint: str | None) -> tuple[str, object]:
        if self.kind == "number":
            if self.token in "01" and len(self.token) == 1 and (hint == "b" or self.o.normalize):
                return "b", self.take("number") == "1"
            if hint == "b":
                raise self.fail("InvalidValue", self.token)
            n = self.number()
            return ("f" if isinstance(n, float) else "i"), n
        if self.kind == "quoted":
            return "s", self.take("quoted")
        if self.kind == "word":
            word = self.take("word")
            if (hint == "b" or self.o.normalize) and word.lower() in _BOOLS:
                return "b", _BOOLS[word.lower()]
            return "s", word
        if self.kind == "[":
            return self.array(hint)
        if self.kind == "{":
            return "r", self.nested()
        raise self.fail("UnexpectedToken", f"no value: {self.token!r}")

    def array(self, hint: str | None) -> tuple[str, list]:
        self.take("[")
        if self.kind == "]":
            self.next()
            return (hint if hint in ("ra", "ia", "fa", "ba") else "sa"), []
        tag = hint if hint in ("ra", "ia", "fa", "ba") else "ra" if self.kind == "{" else "sa"
        if tag == "ra":
            self.deeper()
        item = {"ra": self.nested, "ia": lambda: self.number(True), "fa": lambda: float(self.number()), "ba": self.boolean, "sa": self.string}[tag]
        out = [item()]
        while self.kind == ",":
            self.next()
            out.append(item())
        self.take("]")
        self.depth -= tag == "ra"
        return tag, out

    def string(self) -> str:
        if self.kind not in ("quoted", "word"):
            raise self.fail("UnexpectedToken", f"no string: {self.token!r}")
        return self.take(self.kind)

    def boolean(self) -> bool:
        if self.kind == "number" and self.token in ("0", "1"):
            return self.take("number") == "1"
        if self.kind == "word" and self.token.lower() in _BOOLS:
            return _BOOLS[self.take("word").lower()]
        raise self.fail("InvalidValue" if self.kind in ("number", "word") else "UnexpectedToken", self.token)

    def deeper(self) -> None:
        self.depth += 1
        if self.o.max_depth is not None and self.depth > self.o.max_depth:
            raise self.fail("NestingTooDeep", f"{self.depth} > {self.o.max_depth}")

    def nested(self) -> Record:
        self.take("{")
        self.deeper()
        out: Record = []
        while self.kind != "}":
            out.append(self.field(out))
            if self.kind == ";":
                self.next()
            elif self.kind != "}":
                raise self.fail("UnexpectedToken", f"in a nested record: {self.token!r}")
        self.next()
        self.depth -= 1
        return values.sort(out)

    def limits(self, rec: Record) -> None:
        o = self.o
        seen = 0
        todo = list(reversed(rec))
        while todo:
            fid, tag, v = todo.pop()
            seen += 1
            strings = [v] if tag == "s" else v if tag == "sa" else []
            wrong = (
                (o.max_fields is not None and seen > o.max_fields and "too many fields")
                or (o.max_items is not None and tag in ("sa", "ia", "fa", "ba", "ra") and len(v) > o.max_items and "array too long")
                or (o.max_string is not None and any(len(s.encode()) > o.max_string for s in strings) and "string too long")
            )
            if wrong:
                raise self.fail("InvalidNestedStructure", wrong, fid)
            if tag == "r":
                todo += reversed(v)
            elif tag == "ra":
                todo += [f for x in reversed(v) for f in reversed(x)]


def read(text: str, options: Options | None = None) -> Record:
    o = options or Options()
    return Reader(sanitize(text) if o.lenient else text, o).record()


def parse(df: DataFrame, text: str, *keys: str, options: Options | None = None, mode: str = "permissive", out: str = "fields") -> DataFrame:
    """keys, fields, canonical text and error of each row's record text. mode: permissive keeps bad rows with `error`,
    dropmalformed leaves them out, failfast fails the query. A null text is an empty record."""
    o = options or Options()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shown, errors = [], [], []
            for t in batch.column(text).to_pylist():
                try:
                    rec = read(t or "", o)
                    rows.append(rec)
                    shown.append(values.record_text(rec))
                    errors.append(None)
                except RecordError as e:
                    if mode == "failfast":
                        raise
                    rows.append(None)
                    shown.append(None)
                    errors.append(e.row)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], values.fields_array(rows, fields), pa.array(shown, pa.string()), pa.array(errors, error)], [*keys, out, "canonical", "error"])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL(f"{out} {values.FIELD_SCHEMA}, canonical string, error {values.ERROR_SCHEMA}").fields])
    arrow = to_arrow_schema(schema)
    fields, error = arrow.field(out).type, arrow.field("error").type
    found = df.select(*keys, text).mapInArrow(run, schema)
    return found.where("error is null") if mode == "dropmalformed" else found


def load(spark: SparkSession, path: str, options: Options | None = None, mode: str = "permissive") -> DataFrame:
    """One record a file."""
    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse(files, "value", "path", options=options, mode=mode)


# ---------------------------------------------------------------- repair


_STRING = r'"(?:[^"\\]|\\.)*(?:"|\Z)'


def sanitize(text: str, level: str = "normal", auto_quote: bool = True, booleans: bool = True, numbers: bool = False) -> str:
    """Repairs record text. minimal: blanks at line ends go. normal: also blanks around marks, odd line ends, open
    quotes, values that need quotes. aggressive: also words for booleans, and leading zeros where asked for."""
    if level == "minimal":
        return re.sub(r"[ \t]+(?=\r?\n|\Z)", "", text)
    text = _tidy(text)
    if auto_quote:
        text = _quote(text)
    if level == "aggressive" and (booleans or numbers):
        text = re.sub(rf"({_STRING})|[A-Za-z0-9-]+", lambda m: m[0] if m[1] else _token(m[0], booleans, numbers), text, flags=re.DOTALL)
    return text


def _tidy(text: str) -> str:
    out, in_string = [], False
    for m in re.finditer(r'\\.|\\|"|[^\\"]+', text, re.DOTALL):
        piece = m[0]
        if piece == '"':
            in_string = not in_string
        elif piece == "\\":
            piece = "\\\\"
        elif not in_string and piece[0] != "\\":
            after_string = bool(out) and out[-1][-1:] not in ("", "\n", ";", ",", "=", "[", "{")
            piece = re.sub(r"[ \t]*\r", "\n", piece)
            piece = re.sub(r"([;,])\s+", r"\1", piece)
            piece = re.sub(r"[ \t]+(?=[\n;,=\]}])|(?<=[\n;,=\[{])[ \t]+", "", piece)
            if m.end() == len(text):
                piece = piece.rstrip(" \t")
            if not after_string:
                piece = piece.lstrip(" \t")
            piece = re.sub(r"[ \t]+", " ", piece)
        out.append(piece)
    return "".join(out) + ('"' if in_string else "")


def _quote(text: str) -> str:
    def fix(m: re.Match) -> str:
        bare = m[2].strip()
        if not bare or bare[0] in '"[{' or not ('"' in bare or re.search(r"\s", bare)):
            return m[0]
        return m[1] + '"' + bare.replace("\\", "\\\\").replace('"', '\\"') + '"'

    return re.sub(r'(=)((?:\\.|"(?:[^"\\]|\\.)*"|[^;\n"\\])*)', fix, text, flags=re.DOTALL)


def _token(token: str, booleans: bool, numbers: bool) -> str:
    if booleans and token.lower() in _BOOLS:
        return str(int(_BOOLS[token.lower()]))
    return (token.lstrip("0") or "0") if numbers and len(token) > 1 and token.isdigit() else token


def sanitize_column(df: DataFrame, column: str, **options: object) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else sanitize(t, **options) for t in texts.to_pylist()], pa.string())

    return df.withColumn(column, run(F.col(column)))


def expand_short(text: str) -> str:
    """Full text of a short form: an F before each digit that begins a field outside strings."""
    return re.sub(rf"({_STRING})|(^|[;\n{{])(?=[0-9])", lambda m: m[1] if m[1] else m[2] + "F", text, flags=re.DOTALL)
