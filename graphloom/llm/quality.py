"""Quality rules as a short-circuit cascade of native expressions.

Every rule is one Column over the text. Its cost and its rejection rate are estimated on a bounded
sample; the rules are then ordered by rejection per cost, and one CASE expression tries them in that
order, so that a dear rule only sees what the cheap ones left. The order never changes the verdict
(a document is kept if no rule rejects it), only the work; the reason that is named for one that goes
is the first rule, in the order in which the rules are given, that rejects it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, new_names, text_of

WINDOW = 5
#: How often a rule sees the sample, until its time stands out.
REPEATS = (1, 8, 64)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body (or a lambda in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_dup_line_words(text: Column) -> Column:
    """Words of lines that repeat an earlier one."""
    def words(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + n_words(x))

    return let(lines_with_words(text), lambda x: words(x) - words(F.array_distinct(x)))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def window_hashes(words: Column, width: int) -> Column:
    """Hash of the window that starts at each word; no element for a text of fewer words. ``words``: a bound column.

    Each word is hashed once; a window hashes its words' hashes.
    """
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)])),
            F.lit(1),
            F.greatest(F.size(h) - F.lit(width - 1), F.lit(0)),
        ),
    )


def covered_words(hashes: Column, width: int) -> Column:
    """Words that lie in a window whose hash comes twice or more. ``hashes``: a bound column.

    The windows are sorted by (hash, place): equal ones become neighbours. The places of those are
    sorted again, and each adds as many words as it reaches beyond the one before.
    """
    none = F.lit(None).cast("long")

    def twice(placed: Column) -> Column:
        flagged = F.transform(
            placed,
            lambda x, k: F.when(
                F.coalesce(x["h"] == F.get(placed, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(placed, k - 1)["h"], F.lit(False)),
                x["i"].cast("long"),
            ).otherwise(none),
        )
        return F.sort_array(F.array_compact(flagged))

    reach = F.aggregate(
        let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("p")),
        lambda a, p: F.struct((a["n"] + F.least(p - a["p"], F.lit(width).cast("long"))).alias("n"), p.alias("p")),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(reach["n"])


def n_repeat_words(words: Column) -> Column:
    return let(words, lambda w: let(window_hashes(w, WINDOW), lambda h: covered_words(h, WINDOW)))


class Facts:
    """What rules may ask of a text: from columns that hold it already, else worked out from the text."""

    def __init__(self, text: Column, held: Sequence[str] = ()):
        self.text, self.held = text, set(held)

    def _get(self, name: str, make: Callable[[], Column]) -> Column:
        return F.col(name) if name in self.held else make()

    n_words = property(lambda s: s._get("n_words", lambda: n_words(s.text)))
    word_chars = property(lambda s: s._get("word_chars", lambda: word_chars(s.text)))
    n_symbols = property(lambda s: s._get("n_symbols", lambda: n_symbols(s.text)))
    n_dup_lines = property(lambda s: s._get("n_dup_lines", lambda: n_dup_lines(s.text)))
    n_repeat_words = property(lambda s: s._get("n_repeat_words", lambda: n_repeat_words(words_of(s.text))))
    n_dup_line_words = property(lambda s: n_dup_line_words(s.text))

    def letters(self, kind: str) -> Column:
        return F.length(self.text) - F.length(F.regexp_replace(self.text, kind, ""))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    A null text counts as empty: all zero. A column of ``df`` with one of these names is replaced.
    """
    text = text_of(text_col)
    own = [F.col(f"`{c}`") for c in df.columns if c not in (*COUNTS, "_words")]
    return (
        df.select(*own, words_of(text).alias("_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("n_repeat_words", let(window_hashes(F.col("_words"), WINDOW), lambda h: covered_words(h, WINDOW)))
        .drop("_words")
    )


@dataclass(frozen=True)
class Rule:
    """``rejects``: a Column of the text's facts that is true for what goes; null counts as false."""

    name: str
    rejects: Callable[[Facts], Column]


#: What the base of the contract rejects.
BASE_RULES = (
    Rule("too_few_words", lambda f: f.n_words < 10),
    Rule("repeated_words", lambda f: F.lit(100) * f.n_repeat_words > F.lit(20) * f.n_words),
)
#: The method's own rules. A clean text stays far from every limit: prose has well under one symbol
#: in three words, few words in equal lines (a header that stands twice is few words), words of some 2 to 15 letters and mostly small letters.
OWN_RULES = (
    Rule("symbols", lambda f: F.lit(10) * f.n_symbols > F.lit(3) * f.n_words),
    Rule("equal_lines", lambda f: (f.n_dup_lines > F.lit(0)) & (F.lit(10) * f.n_dup_line_words > F.lit(3) * f.n_words)),
    Rule("word_length", lambda f: (f.word_chars < F.lit(2) * f.n_words) | (f.word_chars > F.lit(25) * f.n_words)),
    Rule("capitals", lambda f: F.lit(2) * f.letters(r"\p{Lu}+") > f.letters(r"\p{L}+")),
)


def estimate(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = 400, seed: int = 7, held: Sequence[str] = ()) -> list[dict]:
    """Cost (seconds on the sample) and rejection rate of each rule, best rejection per cost first.

    The sample holds ``sample_rows`` rows at most, whatever the size of ``df``: whole rows, each drawn by itself
    with a seed, so that no task hands on more than its share. It is only used to order the rules. ``held`` names the
    counts that the rules will find as columns: the sample has them too, so only what a rule adds to them is timed. Each
    rule sees the sample as often as it takes to outlast a job that does nothing, whose time is taken off. Scores within
    a factor of two are ties, and go by name. An empty table leaves the order by name.
    """
    drawn = df.select(F.col(text_col).alias("text"))
    fraction = min(1.0, 1.2 * sample_rows / max(1, df.count()))
    keep = drawn.sample(fraction=fraction, seed=seed).limit(sample_rows)
    keep = (measured(keep) if held else keep).persist()

    def timed(rejects: Column, times: int) -> tuple[float, int]:
        again = keep.withColumn("_again", F.explode(F.array_repeat(F.lit(0), times)))
        t = time.perf_counter()
        gone = again.agg(F.sum(rejects.cast("long"))).first()[0] or 0
        return time.perf_counter() - t, gone // times

    try:
        rows, found = keep.count(), []
        nothing = min(timed(F.length(text_of("text")) < 0, REPEATS[-1])[0] for _ in range(3))
        for r in rules:
            said = F.coalesce(r.rejects(Facts(text_of("text"), held)), F.lit(False))
            timed(said, 1)  # compiles it
            for times in REPEATS:
                seconds, gone = timed(said, times)
                if seconds > 3 * nothing:
                    break
            cost = max(seconds - nothing, nothing / 10) / times
            found.append({"name": r.name, "rule": r, "seconds": cost, "rejects": gone / rows if rows else 0.0})
    finally:
        keep.unpersist()

    def rank(x: dict) -> tuple:
        return (-round(math.log2(x["rejects"] / x["seconds"])) if x["rejects"] else math.inf, x["name"])

    return sorted(found, key=rank)


def verdict(order: Sequence[Rule], facts: Facts) -> Column:
    """The first rule of ``order`` that rejects, else null; a CASE stops at the first that holds."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(r.rejects(facts), F.lit(r.name)).otherwise(out)
    return out


def cascade(df: DataFrame, rules: Sequence[Rule] = BASE_RULES + OWN_RULES, text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """``df`` with ``rejected_by``: the first of ``rules``, as given, that rejects the text, else null.

    The estimated order decides what is tried first; only for a text that goes the rules are gone through again as
    given. Null and empty texts are texts of no words; very long ones are judged whole. Nothing is dropped here; ties
    and repeated rows are judged each by itself. A column of ``df`` of that name is replaced.
    """
    facts = Facts(text_of(text_col))
    return _reasoned(df, [x["rule"] for x in estimate(df, rules, text_col, sample_rows)], rules, facts, F.lit(True))


def _reasoned(df: DataFrame, order: Sequence[Rule], rules: Sequence[Rule], facts: Facts, judged: Column) -> DataFrame:
    (hit,) = new_names(df.columns, 1)
    found = df.withColumn(hit, F.when(judged, verdict(order, facts)))
    return found.withColumn("rejected_by", F.when(F.col(hit).isNotNull(), verdict(rules, facts))).drop(hit)


def keep_clean(df: DataFrame, rules: Sequence[Rule] = BASE_RULES + OWN_RULES, text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with its own columns, of any names.

    Null and empty texts have too few words and go; very long ones are judged whole; repeated rows stay or go together.
    Ids play no part. An empty table gives no rows.
    """
    order = [x["rule"] for x in estimate(df, rules, text_col, sample_rows)]
    return df.filter(verdict(order, Facts(text_of(text_col))).isNull())


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = OWN_RULES, sample_rows: int = 400) -> DataFrame:
    """Per row: id, the five counts, base_failed, kept and rejected_by.

    The counts are reported for every row, so the rules reuse them; what is left to the cascade's order
    are the rules that ask for more than the counts. rejected_by: the first of ``rules``, as given, that rejects a
    text that passes the base. Null and empty texts have no words and fail the base; very long ones are read whole. Null and repeated
    ids and repeated rows each give their row; extra columns are ignored. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [x["rule"] for x in estimate(rows, rules, "text", sample_rows, held=COUNTS)]
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    found = _reasoned(measured(rows).withColumn("base_failed", failed), order, rules, Facts(text_of("text"), COUNTS), ~F.col("base_failed"))
    return found.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
