"""Secret scans, in Column expressions only: known forms, and strings of high entropy.

Known forms (``KINDS``) are searched leftmost and without overlap, each kind by itself. Further
candidates are runs of token characters, without the known forms and sample words in them: what is left on
either side of those is a run of its own. A window slides over each; the counts of the window's
characters and the sum of c log2 c change by the character that comes in and the one that goes out,
which gives its Shannon entropy. Windows over their character class's threshold are the finding, from
the first to the last one, unless an allow-list pattern matches the run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, text_of

#: Patterns of the known forms (the group, and the least characters that it has).
KINDS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Character classes: the first pattern that matches the whole candidate decides; bits per character.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("upper", r"^[0-9A-Z]+$", 3.5), ("mixed", r"", 3.9))
#: Candidates left alone: without both letters and digits, UUIDs, paths and slugs of words.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[+/_=-]*([A-Za-z]{2,}|[0-9]{1,8})([+/_=-]+([A-Za-z]+|[0-9]{1,8}))*[+/_=-]*$",
)
#: Letters and digits around a mark of samples: left alone, but not what other characters part from them.
SAMPLE = r"(?i)[a-z0-9]*(?:example|sample|placeholder|xxxx|0000|1234567)[a-z0-9]*"
WINDOW, SCALE = 20, 1_000_000
_LOW, _HIGH = 43, 122  # characters of candidates lie between + and z
_TERM = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 2)]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order: struct(start, end, text, group), in code points, end exclusive."""

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda a, x: F.struct((a["at"] + x["gap"] + F.coalesce(x["own"], F.lit(0))).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts"))
        starts = F.aggregate(sizes, none, step, lambda a: a["starts"])
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        both = F.zip_with(found, inner, lambda m, g: F.struct(m.alias("text"), g.alias("group")))
        return F.zip_with(
            F.slice(starts, 1, F.size(found)), both, lambda s, m: F.struct(s.alias("start"), (s + F.length(m["text"])).alias("end"), m["text"].alias("text"), m["group"].alias("group"))
        )

    empty = F.array().cast("array<struct<start:int,end:int,text:string,group:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(empty)


def _windows(text: Column) -> Column:
    """struct(first, last) window starts of the candidate that pass, null if none does."""
    most = F.lit(None).cast("long")
    for _, pattern, bits in reversed(CLASSES):
        most = F.when(F.rlike(text, F.lit(pattern)), F.lit(math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE))).otherwise(most)
    term = F.array(*(F.lit(x).cast("long") for x in _TERM))
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - _LOW)

    def slide(codes: Column, most: Column, term: Column) -> Column:
        none = F.struct(
            F.array_repeat(F.lit(0), _HIGH - _LOW + 1).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
        )

        def step(a: Column, c: Column) -> Column:
            out = F.when(a["i"] >= WINDOW, F.get(codes, a["i"] - WINDOW))
            come = F.get(a["n"], c)
            leave = F.get(a["n"], out) + F.when(out == c, 1).otherwise(0)
            plus = F.get(term, come + 1) - F.get(term, come)
            minus = F.coalesce(F.get(term, leave) - F.get(term, leave - 1), F.lit(0))
            counts = F.transform(a["n"], lambda n, k: n + F.when(k == c, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
            return let(
                a["s"] + plus - minus,
                lambda s: let(
                    (a["i"] >= WINDOW - 1) & (s <= most),
                    lambda hit: F.struct(
                        counts.alias("n"), s.alias("s"), (a["i"] + 1).alias("i"),
                        F.when(hit & a["first"].isNull(), a["i"] - WINDOW + 1).otherwise(a["first"]).alias("first"),
                        F.when(hit, a["i"] - WINDOW + 1).otherwise(a["last"]).alias("last"),
                    ),
                ),
            )

        return F.aggregate(codes, none, step, lambda a: F.when(a["first"].isNotNull(), F.struct(a["first"].alias("first"), a["last"].alias("last"))))

    return let(codes, lambda x: let(most, lambda m: let(term, lambda t: slide(x, m, t))))


def _entropy(text: Column, base: Column) -> Column:
    allowed = lambda x: F.exists(F.array(*(F.rlike(x, F.lit(p)) for p in ALLOWED)), lambda hit: hit)

    def runs(m: Column) -> Column:
        """struct(start, text) of what is left of the candidate between known forms and samples."""
        known = F.transform(F.filter(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
        samples = F.transform(_matches(m["text"], SAMPLE), lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end")))
        whole = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
        none = F.struct(m["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))
        step = lambda a, c: F.struct(F.greatest(a["at"], c["end"]).alias("at"), F.concat(a["runs"], whole(a["at"], c["start"])).alias("runs"))
        left = F.aggregate(F.sort_array(F.concat(known, samples)), none, step, lambda a: F.concat(a["runs"], whole(a["at"], m["end"])))
        return F.transform(F.filter(left, lambda r: r["end"] - r["start"] >= WINDOW), lambda r: F.struct(r["start"].alias("start"), F.substring(m["text"], r["start"] - m["start"] + 1, r["end"] - r["start"]).alias("text")))

    asked = F.filter(F.flatten(F.transform(_matches(text, CANDIDATE), runs)), lambda m: ~allowed(m["text"]))
    found = F.transform(asked, lambda m: F.struct(m["start"].alias("at"), _windows(m["text"]).alias("w")))
    hits = F.filter(found, lambda m: m["w"].isNotNull())
    return F.transform(hits, lambda m: F.struct((m["at"] + m["w"]["first"]).alias("start"), F.lit(len(KINDS)).alias("kind"), (m["at"] + m["w"]["last"] + WINDOW).alias("end")))


def base_spans(text: Column) -> Column:
    """struct(start, kind, end) of the known forms, by start, then kind as listed."""

    def found(k: int, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(_matches(text, pattern, group), lambda m: F.length(m["group"]) >= least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    parts = [found(k, *how) for k, how in enumerate(KINDS.values())]
    return F.sort_array(F.concat(*parts))


def scan(df: DataFrame, text_col: str, base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """Adds two columns of array<struct<start, kind, end>>: known forms, and all findings.

    Kinds are indexes into ``NAMES``. Null and empty texts have none. Existing columns of those names are
    replaced. Row by row: no shuffle, and equal rows have equal results.
    """
    text = text_of(text_col)
    with_base = df.withColumn(base_col, base_spans(text))
    return with_base.withColumn(spans_col, F.sort_array(F.concat(F.col(base_col), _entropy(text, F.col(base_col)))))


NAMES = (*KINDS, "entropy")


def named(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        before = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(before).alias("out"))

    done = F.aggregate(spans, none, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
