"""Logged model responses: flags, redaction, retries, chat logs, audit
(SURVEY F10, X6-X9, X13, X16, W3, W4, W5, C1-C4, A7).

The reference calls a model and filters answers before posting; here the
answers arrive as a table and every step is an audit over it: flag, clean,
pick the first acceptable attempt, count.  Phrase lists and templates are
supplied by the caller.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidepool.session import checkpoint_root
from tidepool.functions import text as X

# Roles of a chat log.
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_comply_flag(text) -> Column:
    """``"AI"`` (case-sensitive) together with ``"i cannot"`` (any case)."""
    t = _col(text)
    return t.contains("AI") & F.lower(t).contains("i cannot")


def response_flags(df: DataFrame, text_col: str, phrases: Sequence[str]) -> DataFrame:
    """Per-phrase substring flags (case-insensitive) and the combined flag."""
    t = _col(text_col)
    return df.withColumns({
        "phrase_flag": X.any_phrase(t, phrases),
        "not_comply_flag": not_comply_flag(t),
    }).withColumn("flagged", F.col("phrase_flag") | F.col("not_comply_flag"))


def redact(text, mapping: Sequence[tuple[str, str]], remove: Sequence[str]) -> Column:
    """Map replacements (always lowercasing) then phrase removal."""
    return X.remove_phrases_if_present(X.replace_phrases_lowercasing(text, mapping), remove)


def with_post_processed(df: DataFrame, text_col: str, out_col: str, mapping, remove,
                        markers: Sequence[tuple[str, str]], max_len: int,
                        replacement: str = "") -> DataFrame:
    """The answer as it would be posted: cut marker spans, redact, shorten.

    A chain of projections: every step reads the previous step's column, so
    each intermediate text is computed once per row."""
    out = df.withColumn(out_col, F.col(text_col))
    for start, end in markers:
        out = out.withColumn(out_col, X.cut_between_markers(out_col, start, end))
    out = out.withColumn(out_col, redact(out_col, mapping, remove))
    out = out.withColumn("__longest", F.when(F.length(out_col) > max_len, X.longest_hashtag(out_col)))
    return out.withColumn(
        out_col, F.when(F.col("__longest").isNull(), F.col(out_col))
        .otherwise(X.collapse_ws(F.replace(F.col(out_col), F.col("__longest"), F.lit(replacement))))
    ).drop("__longest")


def first_accepted_attempt(responses: DataFrame, prompt_col: str, attempt_col: str,
                           text_col: str, phrases: Sequence[str], mapping, remove, markers,
                           max_len: int, max_attempts: int) -> DataFrame:
    """Per prompt: the first attempt (<= ``max_attempts``) that is not flagged
    and fits ``max_len`` after post-processing; else status ``not_passed``.

    ``min``/``min_by`` aggregates: combined map-side, so a prompt with many
    attempts never sits whole in one task.
    """
    scored = with_post_processed(response_flags(responses, text_col, phrases), text_col, "__final",
                                 mapping, remove, markers, max_len)
    ok = (~F.col("flagged")) & (F.length("__final") <= max_len) & (F.col(attempt_col) <= max_attempts)
    first = F.min(F.when(ok, F.col(attempt_col)))
    return (scored.groupBy(prompt_col)
            .agg(first.alias("accepted_attempt"),
                 F.min_by(F.col("__final"), F.when(ok, F.col(attempt_col))).alias("final_response"),
                 F.count(F.lit(1)).alias("n_attempts"))
            .withColumn("status", F.when(F.col("accepted_attempt").isNull(), F.lit("not_passed"))
                        .otherwise(F.lit("passed"))))


def seeded_pick(df: DataFrame, group_col: str, id_col: str, seed: str) -> DataFrame:
    """One repeatable "random" row per group: smallest md5(seed:id), then id."""
    key = F.struct(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))).alias("h"),
                   F.col(id_col).alias("i"))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(group_col).agg(F.min_by(row, key).alias("__r")).select("__r.*")


def topic_fallback(survivors: DataFrame, topic_col: str, requested: str, seed: str) -> DataFrame:
    """Rows of the requested topic if it has any, else of the first non-empty
    topic in a seeded order (the reference retries random topics).

    One partial aggregate over topics, then a semi-join against the chosen
    topic: a global aggregate, so exactly one row (a proven broadcast bound).
    """
    # A post without a tag has no topic.  Both branches read what the gates left, once.
    checkpoint_root(survivors.sparkSession)
    survivors = survivors.where(F.col(topic_col) != "").checkpoint()
    counts = survivors.groupBy(topic_col).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((F.col(topic_col) != F.lit(requested)).alias("not_req"),
                     F.md5(F.concat(F.lit(seed + ":"), F.col(topic_col))).alias("h"))
    chosen = counts.where(F.col("n") > 0).agg(F.min_by(F.col(topic_col), order).alias("__t"))
    return survivors.join(chosen, survivors[topic_col] == chosen["__t"], "left_semi")


# ---- chat logs ---------------------------------------------------------------

@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode NFKD (no Spark built-in); ASCII rows pass through untouched."""
    def one(v):
        if v is None or v.isascii():
            return v
        return unicodedata.normalize("NFKD", v)
    return s.map(one)


def prompt_content(text, normalize: bool = True) -> Column:
    """What the user turn carries: links removed, NFKD-normalised on request."""
    return X.clean_links(nfkd(_col(text)) if normalize else _col(text))


def chat_log_build(df: DataFrame, id_col: str, text_col: str, system_text: str,
                   setup_turns: Sequence[tuple[str, str]], normalize: bool = True) -> DataFrame:
    """Long-form chat log per prompt: (id, position, role, content).

    Position 0 is the system row, then the caller's fixed setup turns, then
    the cleaned prompt.  Long form keeps every row bounded however many
    prompts there are; ``array(struct)`` is one ``collect`` away when a
    client needs the nested shape.
    """
    turns = [F.struct(F.lit(0).alias("position"), F.lit(SYSTEM).alias("role"),
                      F.lit(system_text).alias("content"))]
    for i, (role, content) in enumerate(setup_turns, start=1):
        turns.append(F.struct(F.lit(i).alias("position"), F.lit(role).alias("role"),
                              F.lit(content).alias("content")))
    turns.append(F.struct(F.lit(len(setup_turns) + 1).alias("position"), F.lit(USER).alias("role"),
                          prompt_content(text_col, normalize).alias("content")))
    return (df.select(F.col(id_col), F.explode(F.array(*turns)).alias("t"))
            .select(id_col, "t.position", "t.role", "t.content"))


def chat_log_append(history: DataFrame, new: DataFrame, key: str, pos_col: str,
                    role_col: str, content_col: str, normalize: bool = True) -> DataFrame:
    """Append new turns after each log's last position, cleaned like prompts.

    ``new`` carries its own order in ``pos_col`` (0, 1, ...); the history's
    last position per log comes from a partial aggregate, so no log is ever
    gathered into one row.
    """
    last = history.groupBy(key).agg(F.max(pos_col).alias("__last"))
    appended = (new.join(last, key, "left")
                .select(key, (F.coalesce(F.col("__last"), F.lit(-1)) + 1 + F.col(pos_col)).alias(pos_col),
                        role_col, prompt_content(content_col, normalize).alias(content_col)))
    return history.select(key, pos_col, role_col, content_col).unionByName(appended)


def response_log_record(chat_log: DataFrame, key: str, pos_col: str, content_col: str,
                        answers: DataFrame, settings: dict[str, object]) -> DataFrame:
    """The ``ai_params`` row: first and last chat message as ``prompt`` and
    ``question``, the answer, and the run's settings (personality, nuance, mood,
    rules, model, ...).  ``append_history`` aligns it to the table."""
    ends = (chat_log.groupBy(key)
            .agg(F.max_by(F.col(content_col), F.col(pos_col)).alias("question"),
                 F.min_by(F.col(content_col), F.col(pos_col)).alias("prompt")))
    return ends.join(answers, key, "inner").withColumns({k: F.lit(v) for k, v in settings.items()})


def response_report(df: DataFrame, response_col: str | None, fields: dict[str, str]) -> DataFrame:
    """One labelled line per non-empty setting, then a rule line."""
    parts = []
    if response_col:
        r = F.col(response_col)
        parts.append(F.when(r.isNotNull() & (r != ""), F.format_string(
            "Model Response: %s\nResponse Len: %d\n", r, F.length(r))))
    for label, col in fields.items():
        c = F.col(col)
        s = c.cast("string")
        nonempty = c.isNotNull() & (s != "") & (s != "0") & (s != "0.0") & (s != "false")
        parts.append(F.when(nonempty, F.concat(F.lit(label + ": "), s, F.lit("\n"))))
    parts.append(F.lit("-------------------------------"))
    return df.withColumn("report", F.concat_ws("", *parts))


def response_audit(df: DataFrame, group_cols: Sequence[str], text_col: str) -> DataFrame:
    """Counts behind the logged fields: attempts, flags, length, acceptance."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("flagged")).alias("n_flagged"),
        F.count_if(F.col("not_comply_flag")).alias("n_not_comply"),
        F.round(F.avg(F.length(text_col)), 6).alias("avg_len"),
        F.max(F.length(text_col)).alias("max_len"))
