"""Quality rules: a threshold table compiled into one Spark projection.

Word, symbol, line and repetition counts come from built-in array and string functions alone; each rule of the table
then becomes one integer comparison of two counts, and all of them are evaluated in a single projection. There is no
shuffle, no user function and no state, so the work is a scan of the texts whatever their distribution.

Cases: a null text counts as empty and fails ``min_words``; a very long text is counted whole; an empty table gives no
rows; a count on a threshold passes; repeated rows are judged one by one; columns of the
input other than ``doc_id`` and ``text`` are neither read nor returned by ``quality_counts``; ``apply_rules`` keeps
the input's columns whatever their names, as it works on a struct of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm.storage import documents

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that the rules are meant for.
STOP_WORDS = (
    "a an and are as at be by for from has in is it of on or that the this to was were with "
    "das dem den der die ein eine für im in ist mit nicht und von zu "
    "dans de des du en est et la le les par pas pour que qui sur un une "
    "al con del el en es las los más no para por que se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails unless ``low <= per_mille of num / den <= high``; None leaves a side open."""

    name: str
    num: str
    den: str
    low: int | None = None
    high: int | None = None

    def fails(self, counts: dict[str, Column]) -> Column:
        num, den = counts[self.num] * F.lit(1000), counts[self.den]
        tests = []
        if self.low is not None:
            tests.append(num < F.lit(self.low) * den)
        if self.high is not None:
            tests.append(num > F.lit(self.high) * den)
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]


#: The ratio rules, in thousandths; the two base rules stand in ``BASE_RULES``.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=15000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("exclamations", "n_marks", "n_words", high=300),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
)
BASE_RULES = (
    Rule("min_words", "n_words", "one", low=20_000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=300),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_stop_words", "n_lines")


def paired(windows: Column) -> Column:
    """Window hashes with their places, in order of hash."""
    return F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))


def repeated_words(ordered: str, width: int) -> Column:
    """Number of words in windows whose hash occurs more than once; ``ordered``: a column made by ``paired``.

    A lambda evaluates all that stands in it for each element, so it refers to the sorted array by name.
    """
    last = F.size(ordered) - 1
    twice = F.filter(ordered, lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["w"] == x["w"])) | ((i < last) & (F.get(ordered, i + 1)["w"] == x["w"])))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("at"))
    return F.aggregate(
        starts,
        first,
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(width), x - acc["at"])).cast("long").alias("n"), x.alias("at")),
        lambda acc: acc["n"],
    )


def quality_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = 8) -> DataFrame:
    """``keep`` and the counts of every whole text: see COUNTS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    read = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, SPACE_CLASS + "+"), "").alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    spans = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice("_words", i, window)))).otherwise(F.array().cast("array<bigint>"))
    windows = read.select(*keep, "_text", "_words", "_lines", spans.alias("_windows"))
    many = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<w:bigint,i:int>>")
    ordered = windows.select("*", F.when(many, paired(F.col("_windows"))).otherwise(none).alias("_ordered"))
    return ordered.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_ordered", window).alias("n_repeat_words"),
        (F.length("_text") - F.length(F.translate("_text", "!?", ""))).cast("long").alias("n_marks"),
        F.size(F.filter("_words", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> tuple[Column, Column]:
    """(base_failed, kept) over a frame that has the counts."""
    counts = {c: F.col(c) for c in COUNTS} | {"one": F.lit(1)}
    failed = [r.fails(counts) for r in base]
    base_failed = failed[0]
    for x in failed[1:]:
        base_failed = base_failed | x
    kept = ~base_failed
    for r in rules:
        kept = kept & ~r.fails(counts)
    return base_failed, kept


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, base_failed and kept of each row."""
    base_failed, kept = compile_rules()
    # The row number keeps later filters above the counts; pushed below, they would evaluate all of them once more.
    counted = quality_counts(docs, keep).select("*", F.monotonically_increasing_id().alias("_row")).filter("_row >= 0")
    return counted.select(*keep, *COUNTS, base_failed.alias("base_failed"), kept.alias("kept"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all of their columns."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("text"))
    return judge(packed, ("_doc",)).filter("kept").select("_doc.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def _sql_rule(r: Rule) -> str:
    den = "1" if r.den == "one" else r.den
    tests = [f"1000 * {r.num} < {r.low} * {den}"] * (r.low is not None) + [f"1000 * {r.num} > {r.high} * {den}"] * (r.high is not None)
    return "(" + " OR ".join(tests) + ")"


_BASE = " OR ".join(map(_sql_rule, BASE_RULES))
_REST = " OR ".join(map(_sql_rule, RULES))
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
KEPT_CTES = rf"""
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {{documents}}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
      FROM (SELECT rid, i, string_agg(x, ' ') OVER v AS g, count(*) OVER v AS n FROM u
            WINDOW v AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) y WHERE n = 8),
r AS (SELECT rid, sum(least(8, i - p)) AS n FROM (SELECT rid, i, lag(i, 1, -100) OVER (PARTITION BY rid ORDER BY i) AS p FROM g WHERE c > 1) z GROUP BY rid),
q AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS BIGINT) AS n_marks,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
             CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN r ON r.rid = w.rid)
"""
ORACLE = f"""WITH {KEPT_CTES.format(documents="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_stop_words, n_lines,
       ({_BASE}) AS base_failed, NOT ({_BASE} OR {_REST}) AS kept FROM q"""
