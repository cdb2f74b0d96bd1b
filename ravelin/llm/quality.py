"""Quality rules with a bitmask ledger, in DataFrame operations only.

``ledger`` evaluates every rule once and keeps the measurements and one long
whose bit k says that rule k failed.  A policy is a mask of rules with a
version; applying one is an AND, and ``ablation`` finds by bitwise aggregation
how many documents each rule alone holds back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, words_of

#: A rule's bit is its place here: name and SQL test of failure over the measurements.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "2 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
    ("words_too_long", "word_chars > 40 * n_words"),
    ("words_too_short", "2 * word_chars < 3 * n_words"),
)
#: Policies by version: the rules each one enforces.
POLICIES = {
    1: ("too_few_words", "repeated_windows"),
    2: tuple(name for name, _ in RULES),
}
#: Rules whose failure is ``base_failed``.
BASE = POLICIES[1]
WINDOW = 3


def mask(names: tuple[str, ...]) -> int:
    place = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << place[name] for name in names)


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text.

    Windows are sorted as (hash, place); those equal to a neighbour repeat, and
    in order of place each adds the words up to the next one, WINDOW at most.
    """
    n = F.size(ws)
    tail = lambda xs, k: F.slice(xs, F.lit(k + 1), F.greatest(F.size(xs) - k, F.lit(0)))
    zipped = F.arrays_zip(ws.alias("a"), tail(ws, 1).alias("b"), tail(ws, 2).alias("c"))
    windows = F.slice(zipped, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    keyed = F.array_sort(F.transform(windows, lambda g, i: F.struct(F.xxhash64(g["a"], g["b"], g["c"]).alias("h"), i.alias("i"))))
    return keyed


def covered(keyed: Column) -> Column:
    """How many words the repeated windows of ``repeat_words`` cover."""
    size = F.size(keyed)
    back = F.concat(F.array(F.lit(None).cast("long")), F.slice(keyed["h"], 1, F.greatest(size - 1, F.lit(0))))
    ahead = F.concat(F.slice(keyed["h"], F.lit(2), F.greatest(size - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
    marked = F.arrays_zip(keyed.alias("k"), back.alias("p"), ahead.alias("n"))
    twice = F.filter(marked, lambda x: F.coalesce(x["k"]["h"] == x["p"], F.lit(False)) | F.coalesce(x["k"]["h"] == x["n"], F.lit(False)))
    return F.sort_array(twice["k"]["i"])


def stretch(places: Column) -> Column:
    size = F.size(places)
    gaps = F.zip_with(F.slice(places, F.lit(2), F.greatest(size - 1, F.lit(0))), F.slice(places, 1, F.greatest(size - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.when(size > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, the measurements and ``fail_bits``.

    A null or empty text measures 0 everywhere.  Null ids and repeated rows keep
    a row each, very long texts are measured whole, and an empty table gives no rows;
    other columns of ``docs`` are not read.  One pass, no exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words_of(F.col(text_col)).alias("ws"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "t", "ws", lines.alias("lines"), repeat_words(F.col("ws")).alias("keyed"))
    rows = rows.select("*", covered(F.col("keyed")).alias("places"))
    rows = rows.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        stretch(F.col("places")).alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("fail_bits", total)


def judge(rows: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of a policy."""
    return rows.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]) | mask(BASE))) == 0,
    })


def ablation(rows: DataFrame, version: int = 2) -> DataFrame:
    """For each rule of a policy: documents it fails, and those only it holds back."""
    used = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])))
    alone = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    # one row for each distinct set of failures reaches the exchange: 2 ** len(RULES) at most
    sets = rows.withColumn("used", used).groupBy("used").agg(F.count("*").alias("n"))
    return (
        sets.where("used != 0")
        .withColumn("rule", F.explode(F.array([F.struct(F.lit(name).alias("name"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES)])))
        .where(F.col("used").bitwiseAND(F.col("rule.bit")) != 0)
        .groupBy(F.col("rule.name").alias("rule"))
        .agg(F.sum("n").alias("n_failed"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"))
    )


def oracle(version: int = 2) -> str:
    fails = " OR ".join(f"({test})" for name, test in RULES if name in POLICIES[version] + BASE)
    base = " OR ".join(f"({test})" for name, test in RULES if name in BASE)
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))
    return f"""
    WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win FROM w WHERE len(ws) > 2),
    h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
    c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY rid),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN c USING (rid)),
    n AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT ({fails}) AS kept, ({bits})::BIGINT AS fail_bits FROM n"""
