"""Host-level quality rules in DataFrame functions only.

Each document's counts are taken from its whole text. Failures are aggregated by host; a host's rate is
shrunk by a beta prior fitted to all hosts by moments; the host's verdict is joined back and sets how
many lesser failures its documents may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import BROADCAST_BYTES, cut, only

SPACE = " \t\n\x0b\x0c\r"
#: Salts of a host too common for one task, when hosts are too many to broadcast.
SALTS = 64

#: Lesser rules: more symbols than this share of words, more repeated lines than this share of words,
#: words longer or shorter than this on average.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 0.5, 0.05, (2.0, 20.0)


def _repeat_words(k: int) -> Column:
    """Words in windows of k found twice or more. Needs _sorted: (hash, start) of all windows in order."""
    same = lambda i, j: F.coalesce(F.get("_sorted", i)["h"] == F.get("_sorted", j)["h"], F.lit(False))
    return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get("_sorted", i)["i"])), lambda i: i.isNotNull()))


def host(source: Column) -> Column:
    """Up to the first slash, after a scheme, as in quality.site(); null for null."""
    return F.regexp_extract(source.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)


def text_counts(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs' doc_id, _host and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Words are runs of other than the six ASCII white space characters; a null text has none.
    """
    k = window
    t = only(docs, "doc_id", "source", text).toDF("doc_id", "source", "_t").select("doc_id", host(F.col("source")).alias("_host"), F.coalesce("_t", F.lit("")).alias("_t"))
    t = t.withColumn("_trim", F.btrim("_t", F.lit(SPACE)))
    t = t.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", "[ \\t-\\r]+")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    t = t.select(
        "doc_id", "_host", F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("_trim", "\n") == 0, F.array().cast("array<string>")).otherwise(lines).alias("_lines"),
        F.when(F.size("_w") > k, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"),
    )
    t = t.withColumn("_win", F.transform(F.sequence(F.lit(0), F.size("_h") - k), lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(k)))))
    t = t.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    t = t.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    t = t.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), _repeat_words(k)))
    gaps = F.transform(F.sequence(F.lit(1), F.size("_starts") - 1), lambda j: F.least(F.lit(k), F.get("_starts", j) - F.get("_starts", j - 1)))
    covered = F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(k), lambda a, x: a + x))
    return t.select("doc_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def host_rates(counts: DataFrame) -> DataFrame:
    """_host, _n, _rate: failures shrunk by a beta prior (mean and strength by moments over hosts).

    Strength is that of a beta whose variance is the spread of the hosts' raw rates, at least 2 and at most 10,000.
    """
    by = counts.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_fails").cast("long")).alias("_f"))
    raw = F.col("_f") / F.col("_n")
    prior = by.agg((F.sum("_f") / F.sum("_n")).alias("mean"), F.var_pop(raw).alias("spread")).first()
    mean, spread = prior.mean or 0.0, prior.spread or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 10_000.0) if spread > 0 else 10_000.0
    return by.select("_host", "_n", ((F.col("_f") + mean * strength) / (F.col("_n") + strength)).alias("_rate"))


def with_hosts(counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """counts with each host's columns; by broadcast up to BROADCAST_BYTES, beyond by a salted join."""
    key = F.coalesce(F.concat(F.lit("="), "_host"), F.lit(""))
    counts, hosts = counts.withColumn("_key", key), hosts.select(key.alias("_key"), *(c for c in hosts.columns if c != "_host"))
    if hosts.count() * 150 <= BROADCAST_BYTES:
        return counts.join(F.broadcast(hosts), "_key", "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counts.withColumn("_salt", salt).join(salted, ["_key", "_salt"], "left")


def apply_rules(docs: DataFrame, max_host_rate: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Counts, base_failed, host_fail_rate, n_soft_failed and kept for each row of docs(doc_id, text, source, ...).

    base_failed: fewer than min_words words, or over max_repeat_percent of them in repeated windows. A
    document of a host whose shrunk failure rate is above max_host_rate is kept only without any lesser
    failure; of other hosts with one at most. A null source is a host of its own; null texts have no words
    and fail; repeated rows and null ids give a row each; an empty table gives no rows. Other columns, of
    whatever name, are not read.
    """
    c = text_counts(docs)
    words = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / words
    c = c.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    soft = [F.col("n_symbols") / words > MAX_SYMBOLS, F.col("n_dup_lines") / words > MAX_DUP_LINES, (length < WORD_LENGTH[0]) | (length > WORD_LENGTH[1])]
    c = c.withColumn("n_soft_failed", sum((x.cast("int") for x in soft[1:]), soft[0].cast("int")))
    c = cut(c.withColumn("_fails", F.col("base_failed") | (F.col("n_soft_failed") > 0)))
    out = with_hosts(c, host_rates(c))
    kept = ~F.col("base_failed") & (F.col("n_soft_failed") <= F.when(F.col("_rate") > max_host_rate, 0).otherwise(1))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", kept.alias("kept"), F.col("_rate").alias("host_fail_rate"), F.col("n_soft_failed").cast("long"))
