"""Bag-of-words cosine: term vectors, pair scores, near duplicates
(SURVEY A3, A4, J8, J9).

Tokens are Python ``\\w+`` (Unicode letters, numbers, ``_``), case kept.
Scores are computed from integer sums, ``dot / (sqrt(|a|^2) * sqrt(|b|^2))``,
0.0 when a norm is zero -- the same arithmetic as the reference.

Scale notes
* term vectors are the long form ``(id, token, tf)``, counted inside the row
  from its sorted tokens: no exchange, one row is one text;
* ``near_dup_vs_latest`` takes the last ``n`` history rows itself and broadcasts
  only their vectors (a bound fixed by ``n``), joins candidate *occurrences* to
  them and sums per (candidate, history) pair map-side;
* ``near_dup_pairs`` is an all-pairs similarity join: exact copies are
  collapsed first, then every two blocks of vectors meet in a task, where a
  bound that loses no pair picks the candidates (``text_blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import sha256_hex, tokens
from tidepool.operators.classes import FOREST, components_of_forests, thinned
from tidepool.operators.text_blocks import block_files, block_pairs, heaviest_words, near_in_blocks, scores_of, write_blocks
from tidepool.session import checkpoint_root

#: Texts of a block at most, unless the caller gives another number.
BLOCK_TEXTS = 8192


def sum_sq_counts(toks: Column) -> Column:
    """Sum over distinct tokens of count^2, in-row: sort, then run lengths.

    No shuffle: each row's norm comes from its own token array.
    """
    def acc_of(p, r, s):
        return F.named_struct(F.lit("p"), p, F.lit("r"), r.cast("bigint"), F.lit("s"), s.cast("bigint"))

    init = acc_of(F.lit(""), F.lit(0), F.lit(0))

    def step(acc, x):
        return F.when(x == acc["p"], acc_of(x, acc["r"] + 1, acc["s"])) \
            .otherwise(acc_of(x, F.lit(1), acc["s"] + acc["r"] * acc["r"]))

    return F.aggregate(F.sort_array(toks), init, step, lambda acc: acc["s"] + acc["r"] * acc["r"])


def term_counts(text_col) -> Column:
    """``array<struct<token, tf>>`` of a text, in-row and in linear time: sort the
    tokens, find where each run starts, and take the distance to the next run."""
    def bind(value: Column, body) -> Column:
        """``body(value)`` with value computed once: a lambda variable is a name."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def runs(toks: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(toks) - 1),
                          lambda i: (i == 0) | (F.get(toks, i) != F.get(toks, i - 1)))
        return bind(starts, lambda at: F.transform(at, lambda s, i: F.struct(
            F.get(toks, s).alias("token"),
            (F.coalesce(F.get(at, i + 1), F.size(toks)) - s).cast("bigint").alias("tf"))))

    kept = F.sort_array(F.filter(tokens(text_col), lambda w: w != ""))
    return bind(kept, lambda toks: F.when(F.size(toks) > 0, runs(toks)))


def term_frequencies(df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """Long-form term vectors ``(id, token, tf)`` of one text per row; ``carry``
    columns come along.  A text without tokens has no rows."""
    return (df.select(id_col, *carry, F.explode(term_counts(text_col)).alias("__t"))
            .select(id_col, *carry, F.col("__t.token").alias("token"), F.col("__t.tf").alias("tf")))


def cosine_expr(dot: Column, n2a: Column, n2b: Column) -> Column:
    den = F.sqrt(n2a.cast("double")) * F.sqrt(n2b.cast("double"))
    return F.when(den > 0, dot.cast("double") / den).otherwise(F.lit(0.0))


def cosine_pairs(pairs: DataFrame, a_col: str, b_col: str, texts_a: DataFrame,
                 texts_b: DataFrame, a_id: str, a_text: str, b_id: str, b_text: str) -> DataFrame:
    """Cosine score for each given (a, b) pair of texts (0.0 when nothing is shared).

    Only texts that stand in a pair are tokenised; norms come from their own rows.
    """
    # three branches read the pairs: both sides' texts, and the join that puts them together
    checkpoint_root(pairs.sparkSession)
    p = pairs.select(F.col(a_col).alias("__a"), F.col(b_col).alias("__b")).distinct().checkpoint()

    def vectors(texts: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
        used = texts.select(F.col(id_col).alias(key), F.col(text_col).alias("__text")).join(
            p.select(key).distinct(), key, "left_semi")
        return used.select(key, F.coalesce(term_counts("__text"), F.array()).alias(f"{key}v"))

    both = (p.join(vectors(texts_a, a_id, a_text, "__a"), "__a", "left")
            .join(vectors(texts_b, b_id, b_text, "__b"), "__b", "left"))

    def norm2(v: str) -> Column:
        return F.coalesce(F.aggregate(v, F.lit(0).cast("bigint"), lambda s, t: s + t["tf"] * t["tf"]), F.lit(0))

    # b's counts as a map: each of a's tokens is looked up, in-row.
    counts_b = F.map_from_entries("__bv")
    dot = F.coalesce(F.aggregate(
        "__av", F.lit(0).cast("bigint"),
        lambda s, t: s + t["tf"] * F.coalesce(F.try_element_at("__bm", t["token"]), F.lit(0))), F.lit(0))
    return both.withColumn("__bm", counts_b).select(
        F.col("__a").alias(a_col), F.col("__b").alias(b_col),
        cosine_expr(dot, norm2("__av"), norm2("__bv")).alias("cosine"))


def near_dup_vs_latest(candidates: DataFrame, cand_id: str, cand_text: str,
                       history: DataFrame, hist_id: str, hist_text: str,
                       max_cos: float, n: int, order: Sequence[Column]) -> DataFrame:
    """Keep candidates whose cosine with *every* one of the latest ``n`` history
    texts (first by ``order``) is <= ``max_cos``.  Empty history keeps all.

    The ``n`` rows are taken here, so the broadcast side is bounded by ``n``.
    """
    latest = history.orderBy(*order).limit(n).select(hist_id, hist_text)
    htv = (latest.select(F.col(hist_id).alias("__h"), tokens(hist_text).alias("__toks"), hist_text)
           .withColumn("n2h", sum_sq_counts(F.col("__toks"))))
    htv_n = F.broadcast(term_frequencies(htv, "__h", hist_text, "n2h").withColumnRenamed("tf", "tfh"))
    # the norm is computed once per row, before the explode multiplies rows
    vec = (candidates.select(F.col(cand_id).alias("__c"), tokens(cand_text).alias("__toks"))
           .withColumn("n2c", sum_sq_counts(F.col("__toks"))))
    occ = vec.select("__c", "n2c", F.explode("__toks").alias("token"))
    scores = (occ.join(htv_n, "token")
              .groupBy("__c", "n2c", "__h", "n2h").agg(F.sum("tfh").alias("dot")))
    near = (scores.where(cosine_expr(F.col("dot"), F.col("n2c"), F.col("n2h")) > F.lit(max_cos))
            .select("__c").distinct())
    return candidates.join(near, candidates[cand_id] == near["__c"], "left_anti")


def near_dup_members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, rep), one row per row of ``docs``: the representative that stands
    for its text in ``near_dup_pairs`` (the smallest id of the exact copies; null
    for a null text, which is in no pair).

    Hashes travel, not texts.  The representatives are written down first: the join then
    has two exchanges of its own, and Spark can split the rows of a hot text.
    """
    rows = docs.select(F.col(id_col), sha256_hex(text_col).alias("__hash"))
    checkpoint_root(docs.sparkSession)
    reps = rows.where(F.col("__hash").isNotNull()).groupBy("__hash").agg(F.min(id_col).alias("rep")).checkpoint()
    known = rows.where(F.col("__hash").isNotNull()).join(reps, "__hash").select(id_col, "rep")
    return known.unionByName(rows.where(F.col("__hash").isNull()).select(id_col, F.lit(None).cast(known.schema["rep"].dataType).alias("rep")))


def near_dup_classes(docs: DataFrame, id_col: str, text_col: str, min_cos: float) -> DataFrame:
    """(``id_col``, rep, class, cosine, links), one row per row of ``docs``.

    Two documents are in one class if a chain of ``near_dup_pairs`` leads from one text to
    the other; ``class`` is its smallest representative.  ``cosine`` is the text's score
    against the class's text (1.0 for itself; a chain's ends may be below ``min_cos``),
    ``links`` the number of distinct other texts it is paired with.  The pairs themselves
    are never written; a null text has no class.
    """
    members = near_dup_members(docs, id_col, text_col)
    # the pairs are thinned in the task that finds them: no row of Spark is a pair
    manifest = _text_blocks(docs, id_col, text_col, BLOCK_TEXTS)
    files, own = block_files(manifest), heaviest_words(manifest)
    forests = block_pairs(docs.sparkSession, len(files)).mapInArrow(lambda it: thinned(near_in_blocks(it, min_cos, files, own)), FOREST)
    found = components_of_forests(forests).checkpoint()
    scores = scores_of(manifest, found.where(F.col("node") != F.col("class")).select("node", "class"))
    linked = found.join(scores, ["node", "class"], "left").select(
        F.col("node").alias("rep"), "class", "links", F.coalesce("cosine", F.lit(1.0)).alias("cosine")).checkpoint()
    out = members.join(linked, "rep", "left")
    alone = F.when(F.col("rep").isNotNull(), F.lit(1.0))
    return out.select(id_col, "rep", F.coalesce("class", "rep").alias("class"), F.coalesce("cosine", alone).alias("cosine"),
                      F.when(F.col("rep").isNotNull(), F.coalesce("links", F.lit(0).cast("bigint"))).alias("links"))


def near_dup_pairs(docs: DataFrame, id_col: str, text_col: str, min_cos: float, hot_df: int = BLOCK_TEXTS) -> DataFrame:
    """All pairs of distinct texts with cosine >= ``min_cos`` (exact).

    1. Exact copies collapse to one representative (smallest id) carrying a
       copy count: a text repeated a million times costs one vector and no
       quadratic fan-out.  Pairs are reported between representatives;
       ``near_dup_members`` names the members of each.
    2. The vectors are cut into blocks of at most ``hot_df`` texts, so no task
       pairs more holders of a token with as many others, however frequent it
       is.  The blocks are files in the shared folder.
    3. A task reads two blocks.  A bound that loses no pair leaves few
       candidates (``text_blocks``); each is scored from integer sums over its
       whole vectors, exactly as the reference does.
    """
    manifest = _text_blocks(docs, id_col, text_col, hot_df)
    files, own = block_files(manifest), heaviest_words(manifest)
    rep = docs.schema[id_col].dataType.simpleString()
    return block_pairs(docs.sparkSession, len(files)).mapInArrow(
        lambda it: near_in_blocks(it, min_cos, files, own), f"a_id {rep}, b_id {rep}, cosine double, a_copies bigint, b_copies bigint")


def _text_blocks(docs: DataFrame, id_col: str, text_col: str, block_texts: int) -> DataFrame:
    """Files of the distinct texts' vectors; a text without tokens has none."""
    reps = (docs.where(F.col(text_col).isNotNull())
            .groupBy(sha256_hex(text_col).alias("__hash"))
            .agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"),
                 F.min_by(F.col(text_col), F.col(id_col)).alias("__t")))
    words = reps.where(F.col("rep").isNotNull()).select("rep", "copies", tokens("__t").alias("words"))
    return write_blocks(words.where(F.size("words") > 0), block_texts)
