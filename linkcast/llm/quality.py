"""Quality rules as a ledger: every rule once, one bit per failure, policies applied later.

``measure`` computes the measurements of a text, ``ledger`` turns them into one integer
whose bit *k* is set where rule *k* fails. A policy is a versioned mask of bits: a document
is kept when none of them is set. ``apply_policy`` reads the ledger only, and
``ablation`` counts, from at most ``2 ** rules`` distinct ledger values, how many documents
each rule fails and how many it alone fails.

Words are runs of anything but ASCII white space. A null or empty text has no words and
fails the base rule. Repeated rows give repeated rows, a null id stays null, and other
columns are not read. Three-word windows are compared by their 64-bit hash, inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import SPACE_CLASS, SPACES, documents, let, query

# The rules in the order of their bits. A rule fails where its condition holds.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 4 AND 2 * n_dup_lines > n_word_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
    ("capitals", "100 * n_capitals > 30 * n_words"),
    ("few_letters", "100 * n_letter_runs < 60 * n_words"),
    ("exclamations", "100 * n_exclaim > 20 * n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


# Policies by version: the base alone, then with markup and layout junk, then everything.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("symbols", "duplicate_lines", "exclamations"),
    "v2": (1 << len(RULES)) - 1,
}
CURRENT = "v2"


def _covered(words: Column) -> Column:
    """Words in three-word windows that are found twice or more."""

    def repeated(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.transform(
                s,
                lambda x, i: F.when(((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)), x["i"]),
            )
            return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

        def width(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.when(i > 0, F.least(F.lit(3), x - F.get(p, i - 1))).otherwise(3))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        found = let(let(in_order, positions), width)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, repeated))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id and the measurements that the rules read), all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), trimmed.alias("trimmed")).select(
        "doc_id", "text",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
        .otherwise(F.split("trimmed", SPACE_CLASS + "+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    values = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _covered(F.col("words")),
        "n_word_lines": F.size("lines"),
        "n_capitals": count(r"\p{Lu}{2,}"),
        "n_letter_runs": count(r"\p{L}+"),
        "n_exclaim": count(r"!+"),
    }
    return split.select("doc_id", *[v.cast("long").alias(k) for k, v in values.items()])


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``fail_bits`` to the measurements."""
    bits = sum((F.when(F.expr(rule), 1 << k).otherwise(0) for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(version: str = CURRENT) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_alone): failures of each rule, and documents it alone keeps out."""
    policy = POLICIES[version]
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
        for name, bit in BITS.items() if bit & policy
    ])
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return counts.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        total(failed)("n_failed"), total(F.col("bits") == F.col("bit"))("n_alone")
    )


OP3_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
         unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g
  FROM t WHERE len(w) >= 3),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM repeated, (VALUES (0), (1), (2)) AS steps(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_word_lines,
         len(regexp_extract_all(text, '\p{{Lu}}{{2,}}'))::BIGINT AS n_capitals,
         len(regexp_extract_all(text, '\p{{L}}+'))::BIGINT AS n_letter_runs,
         len(regexp_extract_all(text, '!+'))::BIGINT AS n_exclaim
  FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id),
book AS (
  SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))})::BIGINT
         AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & {BASE}) != 0 AS base_failed, (fail_bits & {POLICIES[CURRENT]}) = 0 AS kept
FROM book
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict per document."""
    book = ledger(measure(documents(spark, sf)))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (~apply_policy("base")).alias("base_failed"),
        apply_policy().alias("kept"),
    )
