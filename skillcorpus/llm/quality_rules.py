"""Quality rules with host-level verdicts.

Every document gets rule counts of its own; failures are then summed by host, the rates shrunk by a beta
prior that is fitted to all hosts, and the hosts' verdicts joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcorpus.plans.storage import cut

# The white space that parts words, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words of the array lie in a 3-word window that occurs twice or more in it.

    Windows are packed as (hash, position) into longs and sorted, so that equal ones stand side by side; the time is n log n. Only
    windows whose hash is there twice are then sorted by their words and compared, so that no hash decides anything.
    """

    def of(w: Column) -> Column:
        bits = F.ceil(F.log2(F.size(w).cast("double") + 1)).cast("int")
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        packed = lambda b: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", window(i), b).bitwiseOR(i.cast("long")))

        def maybe(b: Column, s: Column) -> Column:
            head = lambda x: F.call_function("shiftright", x, b)
            twice = F.filter(s, lambda x, i: (F.coalesce(head(F.get(s, i - 1)) == head(x), F.lit(False))) | (F.coalesce(head(F.get(s, i + 1)) == head(x), F.lit(False))))
            at = lambda x: (x - F.call_function("shiftleft", head(x), b)).cast("int")
            return F.sort_array(F.transform(twice, lambda x: _let(at(x), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))))

        def positions(s: Column) -> Column:
            same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"].cast("long")))

        covered = lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(a["to"], x)).alias("n"), (x + 3).alias("to")))["n"]
        return _let(bits, lambda b: _let(F.sort_array(packed(b)), lambda s: _let(maybe(b, s), lambda m: _let(positions(m), covered))))

    return F.when(F.size(words) >= 4, _let(words, of)).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column) -> dict[str, Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text (null: as an empty one)."""
    full = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(full, "[ \\x09-\\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(full, SPACE, "")).cast("long"),
        "n_symbols": (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(words),
    }


def host_verdicts(rows: DataFrame, host: str, failed: str, max_rate: float) -> DataFrame:
    """``host, n_docs, n_failed, rate, host_ok``: rates of failure shrunk by an empirical beta prior.

    The prior has the mean of all hosts' rates and, by the method of moments, their variance less the binomial
    part; where hosts do not differ by more than chance, it weighs as 1000 documents.
    """
    hosts = cut(rows.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")), "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    mean, var, inverse = hosts.agg(F.coalesce(F.avg(raw), F.lit(0.0)), F.coalesce(F.var_samp(raw), F.lit(0.0)), F.coalesce(F.avg(1 / F.col("n_docs")), F.lit(0.0))).first()
    spread = mean * (1 - mean)
    real = max(var - spread * inverse, spread / 1001)  # variance between hosts
    weight = max(spread / real - 1, 0.01) if spread > 0 else 1000.0
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select(host, "n_docs", "n_failed", rate.alias("rate")).withColumn("host_ok", F.col("rate") <= max_rate)


def quality(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_words: int = 50, max_repeat: int = 50, max_host_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, host``, the counts, ``base_failed, host_rate, kept``.

    A document fails by itself with fewer than ``min_words`` words, or where more than ``max_repeat`` percent of
    them lie in repeated 3-word windows. It is kept if it does not fail and its host's shrunk rate of failures is
    at most ``max_host_rate``. Null texts have no words and fail. A null host is the host of empty name. Repeated
    rows count each. Whole texts are read, of any length. Empty input gives no rows.
    """
    counts = cut(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), *[c.alias(k) for k, c in base_counts(F.col(text)).items()]), "quality-counts")
    judged = counts.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    verdicts = host_verdicts(judged, "host", "base_failed", max_host_rate).select("host", F.col("rate").alias("host_rate"), "host_ok")
    return judged.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_ok")
