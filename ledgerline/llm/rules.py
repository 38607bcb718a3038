"""Quality rules by document and by host.

Each document is judged by itself first. Then failures are counted by host, the
hosts' rates are shrunk towards each other by a beta prior estimated from all
hosts (method of moments), and a host whose shrunk rate is too high takes its
documents with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Tables, arrow_map, prefix_hash, stretch_hash, utf8, window_hashes, word_bounds

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = np.frombuffer(text, np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return 0, 0, int(_SYMBOL[data].sum()), 0, 0
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    chars = int((first[end] - first[start]).sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    windows = window_hashes(stretch_hash(prefix_hash(data), start, end), WINDOW)
    repeated = 0
    if len(windows) > 1:
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        cover = np.zeros(len(start) + 1, np.int64)
        cover[at] += 1
        cover[at + WINDOW] -= 1
        repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    return len(start), chars, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the five measures, base_failed) for each row of `docs`."""

    def make(batch: pa.RecordBatch) -> dict:
        found = [measures(t) for t in utf8(batch.column("text"))]
        return {"id": batch.column("id"), "host": batch.column("host"), **{name: [x[i] for x in found] for i, name in enumerate(NAMES)}}

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    judged = arrow_map(rows, "id bigint, host string, " + ", ".join(f"{n} bigint" for n in NAMES), make)
    return judged.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def beta_prior(hosts: DataFrame, least: float = 1e-3) -> tuple[float, float]:
    """Parameters of the prior from (n, failed) of all hosts.

    Mean and variance of the hosts' rates are matched, the sampling noise of
    small hosts taken off; hosts that hardly differ give a firm prior. Only a
    few sums reach the driver.
    """
    rate = F.col("failed") / F.col("n")
    sums = hosts.agg(F.sum("failed").alias("k"), F.sum("n").alias("n"), F.count("*").alias("h"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr"), F.sum(1 / F.col("n")).alias("noise")).first()
    if not sums.n:
        return 1.0, 1.0
    mean = min(max(sums.k / sums.n, least), 1 - least)
    centre = sums.r / sums.h
    spread = sums.rr / sums.h - centre * centre - mean * (1 - mean) * sums.noise / sums.h
    firmness = mean * (1 - mean) / max(spread, mean * (1 - mean) * least) - 1
    firmness = min(max(firmness, 1.0), 1 / least)
    return mean * firmness, (1 - mean) * firmness


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = 0.5) -> DataFrame:
    """(id, the five measures, base_failed, host_rate, kept) for each row of `docs`.

    host_rate is the host's shrunk share of failed documents; a host above
    `most` is rejected with all its documents. Rows without host have a null
    rate and stand for themselves. Null and empty texts have no words and fail.
    Repeated rows count as often as they occur. No rows give no rows.
    """
    tables = Tables(docs.sparkSession, "rules")
    judged = tables.save("documents", document_rules(docs, id_col, text_col, host_col))
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    hosts = tables.save("hosts", hosts)
    alpha, beta = beta_prior(hosts)
    rates = hosts.select("host", ((F.col("failed") + alpha) / (F.col("n") + (alpha + beta))).alias("host_rate"))
    # Spark sends the hosts to every task if they are few, else splits the rows of a large host.
    out = judged.join(tables.save("rates", rates), "host", "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= most)
    return out.select(F.col("id").alias(id_col), *NAMES, "base_failed", "host_rate", kept.alias("kept"))


#: The same over `documents` in SQL; base counts by lists, the prior by one row of sums.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM base WHERE len(words) >= 5
), windows AS (
  SELECT doc_id, i, words[i:i + 4] AS w FROM places
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, b.source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN dup d USING (doc_id) LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT least(greatest(sum(failed) / sum(n), 0.001), 0.999) AS mean, avg((failed / n) * (failed / n)) - avg(failed / n) * avg(failed / n) AS spread, avg(1 / n) AS noise FROM hosts
), prior AS (
  SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * noise, mean * (1 - mean) * 0.001) - 1, 1), 1000) AS firmness FROM sums
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (h.failed + p.mean * p.firmness) / (h.n + p.firmness) AS host_rate,
       NOT base_failed AND coalesce((h.failed + p.mean * p.firmness) / (h.n + p.firmness), 0) <= 0.5 AS kept
FROM judged j LEFT JOIN hosts h ON j.source = h.source, prior p
"""
