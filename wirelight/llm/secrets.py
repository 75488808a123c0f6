"""Secrets by patterns and by sliding-window entropy, in DataFrame functions only.

Base spans come from three patterns. The method adds spans of candidate strings
(runs of letters, digits and `+/_=-`): per character class a window slides over
the candidate, the counts of its characters are updated by the one that enters
and the one that leaves, and with them the sum of n * log2(n) that gives the
window's Shannon entropy. A candidate whose highest window reaches its class's
threshold is a secret, unless an allow-list pattern matches it or a base span
overlaps it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of base spans, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:int,kind:int,end:int>"

CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class CharClass:
    """Candidates that match `every` and all of `some`; windows of `window` characters with at least `bits` of entropy are secrets."""

    every: str
    some: tuple[str, ...]
    window: int
    bits: float


CLASSES = (
    CharClass(r"^[0-9a-f]+$", ("[0-9]", "[a-f]"), 16, 2.9),
    CharClass(r"^[A-Z0-9]+$", ("[0-9]", "[A-Z]"), 20, 3.4),
    CharClass(r"^[a-z0-9_-]+$", ("[0-9]", "[g-z]"), 20, 3.5),
    CharClass(r"[a-z]", ("[0-9]", "[A-Z]"), 20, 3.6),
)
ALLOW = (
    r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|xxxx",
    r"(?i)0123456789|abcdefgh",
    r"(.)\1{7}",
    r"^[0-9/_=+-]+$",
    r"^([A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}$",
)


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep_text: bool = False) -> Column:
    """Spans of a pattern's matches, leftmost and non-overlapping, whose `group` has at least `least` characters."""
    cols = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)]
    if group:
        cols.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, "mpg", strict=False)])
    kind_of = "array<struct<start:int,kind:int,end:int,word:string>>" if keep_text else f"array<{SPAN}>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        fields = [begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *([x["m"].alias("word")] if keep_text else [])]
        fits = x["m"].isNotNull() & (F.length(x["g" if group else "m"]) >= least)
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["out"], F.array(F.struct(*fields)))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind_of))


def _gain(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def find_secrets(text: Column, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW) -> tuple[Column, Column]:
    """The base spans, and the candidates that the method adds, of a text's whole length.

    Both are arrays of (start, kind, end) in code points, end exclusive, kind by
    its place in KINDS. A NULL text has none.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    base = F.sort_array(F.concat(_found(text, ASSIGN, 0, 2, 8), _found(text, ACCESS, 1, 0, 16), _found(text, HEX, 2, 0, 32)))
    words = _found(text, CANDIDATE, 3, 0, 20, keep_text=True)
    return base, F.filter(words, lambda w: _is_secret(w["word"], classes, allow))


def _is_secret(word: Column, classes: Sequence[CharClass], allow: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in reversed(classes):
        fits = word.rlike(c.every)
        for s in c.some:
            fits = fits & word.rlike(s)
        out = F.when(fits, entropy(word, c.window) >= c.bits).otherwise(out)
    for pattern in allow:
        out = F.when(word.rlike(pattern), F.lit(False)).otherwise(out)
    return F.when(word.rlike("[0-9]"), out).otherwise(F.lit(False))


def entropy(word: Column, window: int) -> Column:
    """Highest entropy of the windows of a string, in bits; 0 where it is shorter than a window."""
    held = F.transform(F.array(word), lambda w: _windowed(w, window))
    return held[0]


def _windowed(word: Column, window: int) -> Column:
    place = lambda c: F.position(c, F.lit(ALPHABET))
    steps = F.transform(F.split(word, ""), lambda c, i: F.struct(i.alias("i"), place(c).alias("a"), F.when(i >= window, place(F.substring(word, i - window + 1, F.lit(1)))).otherwise(-1).alias("b")))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("g"), F.lit(0.0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        n = F.transform(s["n"], lambda v, j: v + (j == x["a"]).cast("int") - (j == x["b"]).cast("int"))
        enters = _gain(s["n"][x["a"]] + 1) - _gain(s["n"][x["a"]])
        leaves = F.when(x["b"] >= 0, _gain(s["n"][x["b"]] - 1) - _gain(s["n"][x["b"]])).otherwise(F.lit(0.0))
        g = s["g"] + F.when(x["a"] == x["b"], F.lit(0.0)).otherwise(enters + leaves)
        here = F.when(x["i"] >= window - 1, F.log2(F.lit(float(window))) - g / window).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), g.alias("g"), F.greatest(s["best"], here).alias("best"))

    return F.aggregate(steps, start, step, lambda s: s["best"])


def _render(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str = "text", **given) -> DataFrame:
    """`docs` with `_base` and `_spans`, arrays of (start, kind, end) by start, then kind."""
    base, added = find_secrets(F.col(text_col), **given)
    # A one-row generator evaluates each array once; stacked projections would be merged and repeat the scans.
    docs = docs.select("*", F.inline(F.array(F.struct(base.alias("_base"), added.alias("_added")))))
    apart = F.filter("_added", lambda a: ~F.exists("_base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    plain = F.transform(apart, lambda a: F.struct(a["start"].alias("start"), a["kind"].alias("kind"), a["end"].alias("end")))
    return docs.select("*", F.inline(F.array(F.struct(F.sort_array(F.concat("_base", plain)).alias("_spans"))))).drop("_added")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) per row of `docs`.

    NULL and empty texts have no spans; repeated rows and NULL ids each give a
    row; other columns are not read. An empty table gives no rows.
    """
    found = with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), "_text")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("_id").alias(id_col), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_render(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _render(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret of the text replaced by `mark`; overlapping spans become one. Texts without secrets and NULL stay as they are."""
    found = with_spans(docs, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, clean).otherwise(text)).select(*docs.columns)
