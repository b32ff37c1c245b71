"""Column expressions for post / response text.

All of these are built-in Spark expressions (JVM side, no Python per row).
They reproduce the reference's string helpers; where Python and Java regex
classes differ we spell the class out:

* Python ``\\w`` is Unicode letters, numbers and ``_``  ->  ``[\\p{L}\\p{N}_]``
* Python ``\\s`` / ``str.split()`` is Unicode white space  ->  ``(?U)\\s``
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed patterns (values the results depend on) -----------------------
HASHTAG_RE = r"#([a-zA-Z0-9_]{1,50})"
MENTION_RE = r"@([a-zA-Z0-9_]{1,50})"
# Python's white space = Unicode White_Space plus the four separators \x1c-\x1f.
_WS = r"\s\x1C-\x1F"
LINK_RE = r"(?U)http[^" + _WS + r"]+"
AT_WORD_RE = r"(?U)@[^" + _WS + r"]+"
WS_RE = r"(?U)[" + _WS + r"]+"
TOKEN_RE = r"([\p{L}\p{N}_]+)"
# ASCII punctuation, the same set as Python's string.punctuation.
LEADING_PUNCT_RE = r"^\p{Punct}+"


def _python_digit_class() -> str:
    """Regex class of the characters Python's ``str.isdigit()`` accepts:
    decimal digits plus other digit characters (superscripts, circled...),
    derived from the Unicode database rather than listed by hand."""
    extra = [c for c in range(0x110000)
             if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    runs: list[list[int]] = []          # consecutive code points as ranges
    for c in extra:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    parts = [f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs]
    return r"[\p{Nd}" + "".join(parts) + "]"


DIGIT_CLASS = _python_digit_class()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Python ``text.split()``: runs of Unicode white space, no empty items."""
    return F.filter(F.split(_c(text), WS_RE), lambda w: w != "")


def split_single_space(text) -> Column:
    """Python ``text.split(" ")``: empty items kept."""
    return F.split(_c(text), " ", -1)


def collapse_ws(text) -> Column:
    """Python ``" ".join(text.split())``."""
    return F.array_join(words(text), " ")


def clean_links(text) -> Column:
    """Remove ``http...`` up to the next white space."""
    t = _c(text)
    return F.when(t.contains("http"), F.regexp_replace(t, LINK_RE, "")).otherwise(t)


def remove_mentions(text) -> Column:
    """Drop ``@handle`` words, then collapse white-space runs to one space."""
    return F.regexp_replace(F.regexp_replace(_c(text), AT_WORD_RE, ""), WS_RE, " ")


def _is_digit(c: Column) -> Column:
    """Whether one character is a digit; the class is asked beyond ASCII only."""
    return c.between("0", "9") | ((c > "\x7f") & c.rlike("^" + DIGIT_CLASS + "$"))


def _keep_symbol_free(w: Column) -> Column:
    # kept: longer than one char, no '$', second char not a digit.
    return (F.length(w) > 1) & ~w.contains("$") & ~_is_digit(F.substring(w, 2, 1))


def symbol_free_words(text) -> Column:
    return F.filter(F.split(_c(text), WS_RE), _keep_symbol_free)  # an empty word is too short


def remove_symbols(text) -> Column:
    return F.array_join(symbol_free_words(text), " ")


def remove_hashtags(text) -> Column:
    return F.array_join(F.filter(words(text), lambda w: ~w.contains("#")), " ")


def clean_post(text) -> Column:
    """links -> symbols -> hashtags -> @mentions, in that order.

    Symbols and hashtags are two tests of one filter over one split; the patterns run
    only over texts that hold their first sign."""
    kept = F.filter(F.split(clean_links(text), WS_RE), lambda w: _keep_symbol_free(w) & ~w.contains("#"))
    joined = F.array_join(kept, " ")   # single spaces: nothing to collapse unless a mention goes
    return F.when(_c(text).contains("@"), remove_mentions(joined)).otherwise(joined)


def hashtags(text) -> Column:
    """All ``#tag`` captures (ASCII tag chars, at most 50 per capture)."""
    return F.regexp_extract_all(_c(text), F.lit(HASHTAG_RE), 1)


def mentions(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(MENTION_RE), 1)


def tokens(text) -> Column:
    """Word tokens as Python's ``re.findall(r"\\w+")``; case kept."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_RE), 1)


def first_words(text, n: int) -> Column:
    """The start of a text up to the end of its n-th word: ``tokens`` of it are the first n."""
    word, other = TOKEN_RE[1:-1], TOKEN_RE[1:-1].replace("[", "[^").replace("+", "*")
    return F.regexp_extract(_c(text), f"^(?:{other}{word}){{0,{n}}}", 0)


def with_hashtag_ratio(df, text_col: str, out_col: str = "hashtag_ratio"):
    """Words per hashtag / 10 after cleaning; NULL when under 20 chars.

    drop links -> drop @words -> drop symbol words; then (#non-tag words) /
    max(#tags, 1) / 10.  The text is split once; the kept words are a column of their
    own, so its uses share them, and tags are looked for in words with a ``#`` only.
    """
    text = _c(text_col)
    unlinked = clean_links(text)
    t = F.when(text.contains("@"), F.regexp_replace(unlinked, AT_WORD_RE, "")).otherwise(unlinked)
    tagged, any_tag = F.filter("__kept", lambda w: w.contains("#")), text.contains("#")
    n_tags = F.when(any_tag, F.size(F.regexp_extract_all(F.array_join(tagged, " "), F.lit(HASHTAG_RE), 1))).otherwise(0)
    plain = F.when(any_tag, F.filter("__kept", lambda w: ~w.contains("#"))).otherwise(F.col("__kept"))
    staged = df.withColumn("__kept", symbol_free_words(t)).withColumn("__plain", plain)
    ratio = F.size("__plain").cast("double") / F.greatest(n_tags, F.lit(1)) / F.lit(10.0)
    return (staged.withColumn(out_col, F.when(F.length(F.array_join("__plain", " ")) >= 20, ratio))
            .drop("__kept", "__plain"))


def sha256_hex(text) -> Column:
    """SHA-256 hex of the UTF-8 text (NULL text -> NULL hash, never matches)."""
    return F.sha2(_c(text), 256)


def longest_hashtag(text) -> Column:
    """Longest word starting with '#' after splitting glued tags; first wins ties."""
    tags = F.filter(words(F.replace(_c(text), F.lit("#"), F.lit(" #"))), lambda w: w.startswith("#"))
    return F.when(
        F.size(tags) > 0,
        F.aggregate(tags, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc)),
    )


def replace_longest_hashtag(text, replacement: str = "") -> Column:
    """Remove every occurrence of the longest hashtag, then collapse spaces."""
    t = _c(text)
    longest = longest_hashtag(t)
    return F.when(longest.isNull(), t).otherwise(
        collapse_ws(F.replace(t, longest, F.lit(replacement))))


def shorten_overlong(text, max_len: int, replacement: str = "") -> Column:
    """Apply :func:`replace_longest_hashtag` only when the text is too long."""
    t = _c(text)
    return F.when(F.length(t) > max_len, replace_longest_hashtag(t, replacement)).otherwise(t)


def cut_between_markers(text, start: str, end: str) -> Column:
    """Remove text from the first ``start`` up to (not incl.) the first ``end``.

    Unchanged when a marker is missing or the end marker comes first.
    """
    t = _c(text)
    s = F.instr(t, start)
    e = F.instr(t, end)
    cut = F.concat(F.substring(t, F.lit(1), s - 1), F.substring(t, e, F.lit(2147483647)))
    return F.when((s > 0) & (e >= s), cut).otherwise(t)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode white space both ends)."""
    return F.regexp_replace(c, r"(?U)^[" + _WS + r"]+|[" + _WS + r"]+$", "")


def extract_between_markers(text, start: str, end: str) -> Column:
    """Trimmed text between the first ``start`` and the next ``end``; NULL if absent."""
    t = _c(text)
    s = F.instr(t, start)
    begin = s + F.lit(len(start))
    e = F.position(F.lit(end), t, begin)
    return F.when((s > 0) & (e > 0), strip_ws(F.substring(t, begin, e - begin)))


def trim_leading_punct(text) -> Column:
    return F.regexp_replace(_c(text), LEADING_PUNCT_RE, "")


def symbols(text) -> Column:
    """``$CASHTAG``-like words of a single-space split (the intended rule)."""
    return F.filter(split_single_space(text),
                    lambda w: (F.length(w) > 1) & w.contains("$")
                    & ~F.substring(w, 2, 1).rlike("^" + DIGIT_CLASS + "$"))


def any_phrase(text, phrases: Sequence[str], case_insensitive: bool = True,
               whole_word: bool = False) -> Column:
    """True when any of ``phrases`` occurs in ``text`` (substring by default)."""
    if not phrases:
        return F.lit(False)
    t = F.lower(_c(text)) if case_insensitive else _c(text)
    conds = []
    for p in phrases:
        p2 = p.lower() if case_insensitive else p
        if whole_word:
            conds.append(t.rlike(r"(?U)(?<!\w)" + _java_quote(p2) + r"(?!\w)"))
        else:
            conds.append(t.contains(p2))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _java_quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def replace_phrases_lowercasing(text, mapping: Sequence[tuple[str, str]]) -> Column:
    """Ordered ``text.lower().replace(k.lower(), v)`` over ``mapping`` (always lowercases)."""
    t = _c(text)
    if not mapping:
        return F.lower(t)
    for k, v in mapping:
        t = F.replace(F.lower(t), F.lit(k.lower()), F.lit(v))
    return t


def remove_phrases_if_present(text, phrases: Sequence[str]) -> Column:
    """For each phrase found (case-insensitive): lowercase, then remove it.

    A text with none of the phrases is returned unchanged; otherwise it is
    lowercased once and every phrase removed in order (a phrase not present in
    the lowercased text removes nothing, so the order of checks is kept).
    """
    t = _c(text)
    if not phrases:
        return t
    low = F.lower(t)
    hit = any_phrase(t, phrases)
    out = low
    for p in phrases:
        out = F.replace(out, F.lit(p.lower()), F.lit(""))
    return F.when(hit, out).otherwise(t)
