"""Secrets taken out of requests and of saved bodies, and what was taken out.

Requests are structured: a JSON body loses the whole value of every private key,
whatever stands there, and texts inside it that are JSON themselves are treated
alike; so are forms, whose fields may hold JSON. Saved bodies are pages and data
that must stay valid: named patterns mark the secret part of what they match, and
blocks that state their own length get it restated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MARK = "[REDACTED]"
SECRET = "secret"
REQUEST = "struct<body:string,changed:boolean>"
BODY = "struct<body:string,changed:array<string>>"


@dataclass
class JsonSecrets:
    """Takes values of private keys out of JSON texts; keys are compared without case."""

    private: frozenset[str]
    mark: str = MARK
    found: bool = field(default=False, init=False)

    def text(self, text: str) -> str | None:
        """The text without secrets, or None if it isn't an object or a list in JSON."""
        if not text.lstrip().startswith(("{", "[")):
            return None
        try:
            value = self._inner(json.loads(text, object_pairs_hook=self._object))
        except ValueError:
            return None
        except RecursionError:  # nested too deep to be looked through
            self.found = True
            return json.dumps(self.mark)
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    def _object(self, pairs: list[tuple[str, object]]) -> dict:
        """Called for each object once it is read, the inner ones first."""
        self.found |= any(k.lower() in self.private for k, _ in pairs)
        return {k: self.mark if k.lower() in self.private else self._inner(v) for k, v in pairs}

    def _inner(self, value: object) -> object:
        if isinstance(value, list):
            return [self._inner(v) for v in value]
        if isinstance(value, str):
            nested = JsonSecrets(self.private, self.mark)
            clean = nested.text(value)
            if nested.found:
                self.found = True
                return clean
        return value


def clean_form(text: str, private: frozenset[str], mark: str = MARK) -> tuple[str, bool]:
    """A form's fields with private ones replaced and JSON in others treated as JSON; unchanged if nothing was private."""
    try:
        fields = parse_qsl(text, keep_blank_values=True, strict_parsing=True)
    except ValueError:
        return text, False
    out, changed = [], False
    for key, value in fields:
        secrets = JsonSecrets(private, mark)
        hidden = key.lower() in private
        clean = mark if hidden else secrets.text(value)
        out.append((key, clean if hidden or secrets.found else value))
        changed |= hidden or secrets.found
    return (urlencode(out), True) if changed else (text, False)


def clean_request(body: str | None, content_type: str | None, url: str | None, private: frozenset[str], login: Sequence[str], mark: str = MARK) -> dict:
    """A request's body without secrets. Bodies of login addresses in which nothing private was found by name go altogether."""
    if not body:
        return {"body": body, "changed": False}
    kind = (content_type or "").lower()
    secrets = JsonSecrets(private, mark)
    if (clean := secrets.text(body)) is not None:
        out, changed = (clean, True) if secrets.found else (body, False)
    elif "form" in kind or "=" in body and "json" not in kind:
        out, changed = clean_form(body, private, mark)
    else:
        out, changed = body, False
    if not changed and any(part in urlsplit(url or "").path.lower() for part in login):
        return {"body": mark, "changed": True}
    return {"body": out, "changed": changed}


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(T.StructType.fromDDL(f"x {kind}")[0].dataType)


def _slices(*columns: pa.Array, size: int = 500) -> Iterator[Iterator[tuple]]:
    """Rows of columns, so many at a time: only these stand as Python's own values."""
    for start in range(0, len(columns[0]), size):
        yield zip(*[c.slice(start, size).to_pylist() for c in columns], strict=True)


def redacted_requests(private: Sequence[str], login: Sequence[str] = (), mark: str = MARK) -> Callable[[Column, Column, Column], Column]:
    """A function of (body, content type, url) that gives struct(body, changed); several of a query's run in one Python worker of a task."""
    keys, kind = frozenset(k.lower() for k in private), _arrow(REQUEST)

    def run(bodies: pa.Array, kinds: pa.Array, urls: pa.Array) -> pa.Array:
        parts = [pa.array([clean_request(b, k, u, keys, login, mark) for b, k, u in rows], kind) for rows in _slices(bodies, kinds, urls)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, REQUEST)


# ---- saved bodies ------------------------------------------------------------------

#: Parts of content types that are text, and of those that are code and stay as they are. Fixed values.
TEXTUAL = ("text/", "json", "javascript", "xml", "x-www-form-urlencoded")
CODE = ("javascript", "ecmascript", "text/jscript", "application/wasm")


@dataclass(frozen=True)
class Rule:
    """A named pattern whose group `secret` is replaced by stand_in."""

    name: str
    pattern: str
    stand_in: str = MARK
    flags: int = re.IGNORECASE | re.DOTALL


def query_rule(keys: Sequence[str], mark: str = MARK) -> Rule:
    """A secret in an address or form: its key stands at the start of the body or after ? or &, which code doesn't."""
    return Rule("query", rf"(?:(?:^|[?&]|&amp;)(?P<name>{'|'.join(map(re.escape, keys))}))=(?P<{SECRET}>[^&\"'\\\s<>]+)", mark, 0)


_SIZED = re.compile(r"<script\b[^>]*?\bdata-content-len=\"(?P<size>\d+)\"[^>]*>(?P<block>.*?)</script>", re.DOTALL)


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with other texts in place of spans, which are in order."""
    parts, at = [], 0
    for a, b, new in spans:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def restated(text: str) -> str:
    """Script blocks that state their length in bytes, with the length they have."""
    return _replaced(text, [(*m.span("size"), str(len(m["block"].encode()))) for m in _SIZED.finditer(text)])


def clean_body(body: str | None, content_type: str | None, rules: Sequence[tuple[Rule, re.Pattern]]) -> dict:
    kind = (content_type or "").lower()
    textual = any(t in kind for t in TEXTUAL) if kind else (body or "")[:1] in ("<", "{", "[", "f")
    if not body or not textual or any(c in kind for c in CODE):
        return {"body": body, "changed": []}
    out, changed = body, set()
    for rule, pattern in rules:
        hits = list(pattern.finditer(out))
        changed |= {m.groupdict().get("name") or rule.name for m in hits}
        out = _replaced(out, [(*m.span(SECRET), rule.stand_in) for m in hits])
    return {"body": restated(out) if changed else body, "changed": sorted(changed)}


def redacted_bodies(rules: Sequence[Rule]) -> Callable[[Column, Column], Column]:
    """A function of (body, content type) that gives struct(body, names of what was taken out)."""

    kind = _arrow(BODY)

    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        own = [(r, re.compile(r.pattern, r.flags)) for r in rules]
        parts = [pa.array([clean_body(b, k, own) for b, k in rows], kind) for rows in _slices(bodies, kinds)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, BODY)


def redacted_headers(headers: Column, private: tuple[str, ...]) -> Column:
    return F.filter(headers, lambda h: ~F.lower(F.coalesce(h["name"], F.lit(""))).isin(*private))


def rules_from(config: Mapping[str, Mapping[str, str]]) -> list[Rule]:
    """Rules of a configuration: by name a pattern and, if it isn't MARK, a stand_in; a pattern without its secret group is refused."""
    for name, entry in config.items():
        if SECRET not in re.compile(entry["pattern"]).groupindex:
            raise ValueError(f"{name}: the pattern has no group named {SECRET}")
    return [Rule(name, entry["pattern"], entry.get("stand_in", MARK)) for name, entry in config.items()]
