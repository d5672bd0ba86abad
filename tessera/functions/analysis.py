"""Text analysis: char filters, a tokenizer and token filters make a column of tokens with their positions.

Chains of white-space tokens, lower case, possessives and stop words are DataFrame functions. Those that need Unicode
segmentation, normalisation or stemming run as one Arrow UDF for the whole chain.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache, lru_cache
from html.entities import html5

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import RequestError

Step = str | tuple
#: Analyzers by name: char filters, tokenizer, filters.
ANALYZERS: dict[str, tuple[Step, ...]] = {
    "whitespace": ("whitespace",),
    "whitespace_lower": ("whitespace", "lowercase"),
    "keyword": ("keyword",),
    "words": ("unicode_word",),
    "standard": ("unicode_word", "nfkc_cf"),
    "english": ("unicode_word", "nfkc_cf", "fold", "kstem"),
    "html": ("html_strip", "unicode_word", "nfkc_cf"),
}
#: Steps that any analyzer may use, added by register().
CUSTOM: dict[str, Callable[[str], str]] = {}
CHAR_FILTERS = ("html_strip", "mapping", "nfkc_cf_chars")
NATIVE = ("whitespace", "keyword", "lowercase", "english_possessive", "stop")
GAP = 100
#: Characters of texts that a step in Python holds as tokens at a time (one longer text alone), and spellings that it keeps.
CHARS_AT_ONCE = 1 << 18
KEPT_TOKENS = 1 << 16
#: Fixed names: elements that flow within a line, and those whose content is no text.
INLINE = "a abbr acronym b basefont bdo big cite code dfn em font i img input kbd label q s samp select small span strike strong sub sup textarea tt u var".split()
SILENT = "script style".split()


def register(name: str, step: Callable[[str], str]) -> None:
    """A token filter of one's own: a token, or None to drop it."""
    CUSTOM[name] = step


def analyzer(spec: str | Sequence[Step]) -> tuple[Step, ...]:
    if isinstance(spec, str):
        if spec not in ANALYZERS:
            raise RequestError("unknown_analyzer", f"no analyzer {spec}")
        return ANALYZERS[spec]
    steps = tuple(tuple(s) if isinstance(s, list) else s for s in spec)
    named = [s if isinstance(s, str) else s[0] for s in steps]
    return steps if {"whitespace", "keyword", "unicode_word"} & set(named) else ("whitespace", *steps)


@cache
def _entity() -> re.Pattern:
    return re.compile(r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|(?:" + "|".join(sorted(map(re.escape, html5), key=len, reverse=True)) + "))")


def html_strip(text: str) -> str:
    """Text without mark-up: inline tags vanish, others break the line, scripts and styles break it and drop their content.

    Entities are decoded once; an unterminated comment eats the rest; CDATA is literal. A `<` that opens nothing stays.
    """
    out, at = [], 0
    tag = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>")
    while (open_ := text.find("<", at)) >= 0:
        out.append(_decoded(text[at:open_]))
        if text.startswith("<!--", open_):
            end = text.find("-->", open_ + 4)
            at = len(text) if end < 0 else end + 3
        elif text.startswith("<![CDATA[", open_):
            end = text.find("]]>", open_)
            end = len(text) if end < 0 else end
            out.append(text[open_ + 9 : end])
            at = end + 3
        elif text.startswith(("<!", "<?"), open_):
            end = text.find(">", open_)
            at = len(text) if end < 0 else end + 1
        elif found := tag.match(text, open_):
            name = found[1].lower()
            at = found.end()
            if name in SILENT and text[open_ + 1] != "/":
                close = re.compile(rf"</{name}\s*>", re.I).search(text, at)
                at = close.end() if close else len(text)
            if name not in INLINE:
                out.append("\n")
        else:
            out.append("<")
            at = open_ + 1
    return "".join([*out, _decoded(text[at:])])


def _decoded(text: str) -> str:
    return _entity().sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


@lru_cache(1 << 16)
def nfkc_cf(text: str) -> str:
    """NFKC_Casefold: compatibility forms folded, ignorable characters dropped."""
    if text.isascii():
        return text.lower()
    while True:
        now = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text.casefold()))
        if now == text:
            return now
        text = now


@lru_cache(1 << 16)
def fold(text: str) -> str:
    """Without accents; letters that don't decompose go to their usual plain spelling."""
    if text.isascii():
        return text
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", plain.translate(str.maketrans({"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ð": "d", "ı": "i"})))


def possessive(token: str) -> str:
    return re.sub("['’＇][sS]$", "", token)


#: Words of the language that stemming must not touch, as far as its rules would.
KEPT = frozenset("this his is was has as us bus gas yes its thus always perhaps news series species various during nothing something anything everything morning evening king ring sing bring thing string spring wing being red bed need feed seed indeed speed hundred".split())


@lru_cache(1 << 16)
def kstem(token: str) -> str:
    """Inflections off a word of 3 to 49 small letters: plurals, -ed, -ing, by the published rules and without a lexicon."""
    token = possessive(token)
    if not re.fullmatch(r"[a-z]{3,49}", token) or token in KEPT:
        return token
    for end, to, least in (("sses", "ss", 0), ("ies", "y", 4), ("xes", "x", 0), ("ches", "ch", 0), ("shes", "sh", 0), ("zzes", "zz", 0)):
        if token.endswith(end) and len(token) > least:
            return token[: -len(end)] + to
    if token.endswith("s") and not token.endswith(("ss", "us", "is")):
        return token[:-1]
    for end in ("ing", "ed"):
        root = token.removesuffix(end)
        if root != token and len(root) > 2 and re.search("[aeiouy]", root):
            if root[-1] == root[-2] and root[-1] not in "lsz":
                return root[:-1]
            if end == "ed" and root.endswith("i"):
                return root[:-1] + "y"
            return root + "e" if re.search(r"(?:at|bl|iz|v|[^aeiou][aeiou][cgsz]|u)$", root) else root
    return token


#: Words by Unicode's boundaries: letters and digits joined by connectors and single marks, kana runs, single ideographs.
_WORD = regex.compile(
    r"[\p{Script=Han}\p{Script=Hiragana}]|\p{Script=Katakana}+|(?:(?:\p{Alphabetic}|\p{Nd}|\p{Pc}|\p{M}|‍)+(?:[.:·’'‘․﹒＇．](?=\p{Alphabetic})(?<=\p{Alphabetic}.)|[.,;’'](?=\p{Nd})(?<=\p{Nd}.))?)+",
)


_LETTER = regex.compile(r"[\p{Alphabetic}\p{Nd}]")
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")


#: The same for ASCII.
_ASCII_WORD = re.compile(r"\w+(?:(?:(?<=[A-Za-z])[.:'](?=[A-Za-z])|(?<=[0-9])[.,;'](?=[0-9]))\w+)*", re.A)


def unicode_words(text: str) -> list[str]:
    if text.isascii():
        return [w for w in _ASCII_WORD.findall(text) if w.strip("_")]
    return [w for w in _WORD.findall(text) if w.isalpha() or _LETTER.search(w)]


def split(steps: Sequence[Step], text: str) -> Sequence[str]:
    """Tokens of one text by char filters and, as the last of `steps`, the tokenizer; white space without one."""
    for step in steps:
        name, *args = (step,) if isinstance(step, str) else step
        if name == "html_strip":
            text = html_strip(text)
        elif name == "mapping":
            table = dict(args[0])
            text = re.sub("|".join(re.escape(k) for k in sorted(table, key=len, reverse=True)), lambda m: table[m[0]], text) if table else text
        elif name == "nfkc_cf":
            text = nfkc_cf(text)
        elif name == "whitespace":
            return text.split()
        elif name == "keyword":
            return [text]
        elif name == "unicode_word":
            return unicode_words(text)
        else:
            raise RequestError("bad_analyzer", f"{name} needs a tokenizer before it")
    return text.split()


def _change(step: Step) -> Callable[[str], str | None]:
    name, *args = (step,) if isinstance(step, str) else step
    if name == "stop":
        words = set(args[0])
        return lambda t: None if t in words else t
    change = {"lowercase": str.lower, "nfkc_cf": nfkc_cf, "fold": fold, "english_possessive": possessive, "kstem": kstem, **CUSTOM}.get(name)
    if change is None:
        raise RequestError("bad_analyzer", f"no step {name}")
    return change


def filtered(steps: Sequence[Step], tokens: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Tokens and positions after token filters; stop words leave holes."""
    for change in map(_change, steps):
        tokens = [(now, p) for t, p in tokens if (now := change(t))]
    return tokens


def run(steps: Sequence[Step], text: str) -> list[tuple[str, int]]:
    """Tokens and positions of one text; stop words leave holes."""
    names = [s if isinstance(s, str) else s[0] for s in steps]
    cut = next((i + 1 for i, n in enumerate(names) if n in ("whitespace", "keyword", "unicode_word")), len(steps))
    return filtered(steps[cut:], [(t, i) for i, t in enumerate(split(steps[:cut], text))])


def terms(spec: str | Sequence[Step], text: str) -> list[tuple[str, int]]:
    """What a query's words become, on the driver."""
    return run(analyzer(spec), text)


def folded(spec: str | Sequence[Step], text: str) -> str:
    """A partial term (prefix, fuzzy, bound): the folding steps only."""
    for step in analyzer(spec):
        if step in ("lowercase", "nfkc_cf", "fold"):
            text = {"lowercase": str.lower, "nfkc_cf": nfkc_cf, "fold": fold}[step](text)
    return text


TOKEN = "array<struct<t:string,p:int>>"


def tokens(c: Column, spec: str | Sequence[Step], multi: bool = False) -> Column:
    """array<struct<t, p>> of a text column (of an array if `multi`, values 100 apart); null for null."""
    steps = analyzer(spec)
    if not multi and all((s if isinstance(s, str) else s[0]) in NATIVE for s in steps):
        return _native(c, steps)

    @F.arrow_udf(TOKEN)
    def run_(values: pa.Array) -> pa.Array:
        return made(values, steps, multi)

    # Told to be indeterminate, it runs once a row, however many conditions and scores read its tokens.
    return run_.asNondeterministic()(c)


def made(values: pa.Array, steps: Sequence[Step], multi: bool) -> pa.Array:
    """Tokens of texts; those of CHARS_AT_ONCE characters are Python objects at a time."""
    many, parts, at = _Bulk(steps), [], 0
    while at < len(values):
        held, room = [], CHARS_AT_ONCE
        while at < len(values) and (room > 0 or not held):
            held.append(values[at].as_py())
            room -= sum(len(t or "") for t in held[-1] or ()) if multi else len(held[-1] or "")
            at += 1
        parts.append(_listed(held, many, multi))
    return pa.concat_arrays(parts) if parts else _listed([], many, multi)


class _Memo(dict):
    """What filters make of a token, worked out once while it is kept."""

    def __init__(self, change: Callable[[str], str | None]):
        super().__init__()
        self.change = change

    def __missing__(self, token: str) -> str | None:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        made = self[token] = self.change(token)
        return made


class _Bulk:
    """run() over many texts: (tokens, positions) of each. Filters see each spelling once, unless they are one's own."""

    def __init__(self, steps: Sequence[Step]):
        self.steps = steps
        names = [s if isinstance(s, str) else s[0] for s in steps]
        cut = next((i + 1 for i, n in enumerate(names) if n in ("whitespace", "keyword", "unicode_word")), len(steps))
        self.head, tail = steps[:cut], steps[cut:]
        changes = self.filters = [_change(s) for s in tail]

        def whole(token: str | None) -> str | None:
            for change in changes:
                if not (token := change(token)):
                    return None
            return token

        self.memo = None if set(names[cut:]) & set(CUSTOM) else _Memo(whole)

    def __call__(self, text: str) -> tuple[list[str], Sequence[int]]:
        if self.memo is None:
            own = run(self.steps, text)
            return [t for t, _ in own], [p for _, p in own]
        made = split(self.head, text)
        if not self.filters:
            return made, range(len(made))
        made = list(map(self.memo.__getitem__, made))
        if all(made):
            return made, range(len(made))
        return [t for t in made if t], [p for p, t in enumerate(made) if t]


def _listed(values: list, many: _Bulk, multi: bool) -> pa.Array:
    ends: list[int | None] = []
    found: list[str] = []
    places: list[int] = []
    for value in values:
        if value is None:
            ends.append(None)
            continue
        ends.append(len(found))
        at = 0
        for text in value if multi else (value,):
            own, spots = ([], ()) if text is None else many(text)
            found += own
            places += [p + at for p in spots] if at else spots
            at = (spots[-1] + at + 1 if len(own) else at) + GAP
    ends.append(len(found))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(places, pa.int32())], names=["t", "p"]))


def _native(c: Column, steps: Sequence[Step]) -> Column:
    words = F.array(c) if "keyword" in steps else F.filter(F.split(c, r"\s+"), lambda t: t != "")
    for step in steps:
        if step == "lowercase":
            words = F.transform(words, F.lower)
        elif step == "english_possessive":
            words = F.transform(words, lambda t: F.regexp_replace(t, "['’＇][sS]$", ""))
    out = F.transform(words, lambda t, i: F.struct(t.alias("t"), i.alias("p")))
    for step in steps:
        if not isinstance(step, str) and step[0] == "stop":
            gone = list(step[1])
            out = F.filter(out, lambda x: ~x.t.isin(gone))
    # A condition that isn't deterministic keeps the plan from repeating the tokens in each filter and score that reads them.
    return F.when(c.isNotNull() & (F.spark_partition_id() >= 0), out)
