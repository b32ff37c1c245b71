"""DuckDB forms of the fixture views and SQL fragments for the oracles.

The oracle of every query is an independent statement over the raw tables:
the views below are prepended as CTEs (only those needed, in dependency
order).  Fragments mirror the Spark column functions with RE2 syntax.
"""

from __future__ import annotations

#: The text of all paragraphs of a page, joined by single spaces.
PAGE_TEXT = ("regexp_replace(array_to_string(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's'), ' '), "
             "'<[^>]+>', '', 'g')")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "posts": ((), """
select doc_id as post_id, n_chars % 150 as author_id, lang, source,
  concat(text,
         ' #topic', cast(n_chars % 7 as varchar),
         case when n_chars % 3 = 0 then ' #Trend_1#deal' else '' end,
         case when n_chars % 5 = 0 then ' @user_9 giveaway' else '' end,
         ' http://news.example.org/', cast(n_chars % 40 as varchar)) as full_text,
  50 + (doc_id * 37) % 1000 as followers_count,
  20 + (doc_id * 53) % 1500 as friends_count,
  1 + (doc_id * 91) % 5000 as statuses_count,
  (doc_id * 17) % 300 as retweet_count,
  doc_id % 11 = 0 as is_retweet, doc_id % 13 = 0 as is_reply
from documents"""),
    "mentions": ((), """
select conv_id * 100 + turn as mention_id, conv_id % 150 as user_id,
  'user_' || cast(conv_id % 150 as varchar) as user_name,
  concat('@user_9 ', text, case when turn % 4 = 0 then ' http://news.example.org/1' else '' end) as full_text
from conversations where role = 'user'"""),
    "replies": ((), """
select r.conv_id * 100 + r.turn as reply_id,
  r.conv_id * 100 + case when r.conv_id % 3 = 0 then f.t else r.turn - 1 end as in_reply_to_id,
  r.text as reply_text
from conversations r
join (select conv_id, min(turn) as t from conversations where role = 'user' group by conv_id) f
  on r.conv_id = f.conv_id
where r.role = 'assistant'"""),
    "responses": ((), """
select conv_id as prompt_id,
  cast(row_number() over (partition by conv_id order by turn) as bigint) as attempt,
  concat(case when (conv_id + turn) % 4 = 0 then 'As an AI I cannot do that. ' else '' end,
         text,
         case when conv_id % 5 = 0 then ' #sarcasm#averyverylongtag #tag' else '' end) as response
from conversations where role = 'assistant'"""),
    "news": ((), f"""
select page_id as news_id, url,
  concat(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' -')[1], '. ',
         {PAGE_TEXT}) as body,
  {PAGE_TEXT} as description,
  concat(cast(1 + page_id % 30 as varchar),
         case page_id % 3 when 0 then ' minutes ago' when 1 then ' hours ago' else ' days ago' end) as age_text,
  'news_' || cast(page_id % 2 as varchar) as feed
from pages"""),
    "replied_tweets": (("posts",), """
select full_text as input_tweet, post_id as input_tweet_id, author_id, 'ok' as status,
  sha256(full_text) as input_tweet_hash
from posts where post_id % 10 = 0"""),
    "timeline_posts": (("news",), """
select timestamp '2024-01-01 00:00:00' + to_minutes(cast(news_id * 7919 % 10007 as int)) as date,
  body, url as input_text_url, news_id, description, sha256(description) as description_hash
from news where news_id % 10 = 0"""),
    "mentions_history": (("mentions", "replies"), """
select m.mention_id as in_reply_to_status_id, sha256(m.full_text) as in_reply_to_text_hash,
  r.reply_id as replay_tweet_id
from mentions m join replies r on r.in_reply_to_id = m.mention_id where m.mention_id % 3 = 0"""),
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views (and their dependencies), then ``body``.

    ``extra`` adds query-local CTEs after the views, in the given order.
    """
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in order]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v.strip()})")
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# ---- SQL fragments (DuckDB) -------------------------------------------------

HASHTAG = r"'#([a-zA-Z0-9_]{1,50})'"
TOKEN = r"'([\p{L}\p{N}_]+)'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def collapse_ws(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def clean_links(x: str) -> str:
    return rf"regexp_replace({x}, 'http\S+', '', 'g')"


def remove_mentions(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '@\S+', '', 'g'), '\s+', ' ', 'g')"


def symbol_free_words(x: str) -> str:
    return (f"list_filter({words(x)}, lambda w: length(w) > 1 AND NOT contains(w, '$') "
            r"AND NOT regexp_matches(substr(w, 2, 1), '^\p{Nd}$'))")


def remove_symbols(x: str) -> str:
    return f"array_to_string({symbol_free_words(x)}, ' ')"


def remove_hashtags(x: str) -> str:
    return f"array_to_string(list_filter({words(x)}, lambda w: NOT contains(w, '#')), ' ')"


def clean_post(x: str) -> str:
    return remove_mentions(remove_hashtags(remove_symbols(clean_links(x))))


def hashtags(x: str) -> str:
    return f"regexp_extract_all({x}, {HASHTAG}, 1)"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {TOKEN}, 1)"


def hashtag_ratio(x: str) -> str:
    t = remove_mentions(clean_links(collapse_ws(x)))
    kept = symbol_free_words(t)
    n_tags = f"len(regexp_extract_all(array_to_string({kept}, ' '), {HASHTAG}, 1))"
    plain = f"list_filter({kept}, lambda w: NOT contains(w, '#'))"
    return (f"(CASE WHEN length(array_to_string({plain}, ' ')) >= 20 THEN "
            f"cast(len({plain}) as double) / greatest({n_tags}, 1) / 10.0 END)")


def hashtag_ratio_ok(x: str, min_ratio: float = 0.5) -> str:
    return f"coalesce({hashtag_ratio(x)} > {min_ratio}, false)"


def strip_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def longest_hashtag(x: str) -> str:
    tags = f"list_filter({words(f'replace({x}, {q(chr(35))}, {q(' #')})')}, lambda w: starts_with(w, '#'))"
    return (f"(CASE WHEN len({tags}) > 0 THEN list_reduce({tags}, "
            f"lambda a, w: CASE WHEN length(w) > length(a) THEN w ELSE a END) END)")


def replace_longest_hashtag(x: str, repl: str = "") -> str:
    lt = longest_hashtag(x)
    return f"(CASE WHEN {lt} IS NULL THEN {x} ELSE {collapse_ws(f'replace({x}, {lt}, {q(repl)})')} END)"


def shorten_overlong(x: str, max_len: int, repl: str = "") -> str:
    return f"(CASE WHEN length({x}) > {max_len} THEN {replace_longest_hashtag(x, repl)} ELSE {x} END)"


def cut_between_markers(x: str, start: str, end: str) -> str:
    s = f"strpos({x}, {q(start)})"
    e = f"strpos({x}, {q(end)})"
    return (f"(CASE WHEN {s} > 0 AND {e} >= {s} THEN concat(substr({x}, 1, {s} - 1), substr({x}, {e})) "
            f"ELSE {x} END)")


def any_phrase(x: str, phrases, case_insensitive: bool = True) -> str:
    if not phrases:
        return "false"
    t = f"lower({x})" if case_insensitive else x
    parts = [f"contains({t}, {q(p.lower() if case_insensitive else p)})" for p in phrases]
    return "(" + " OR ".join(parts) + ")"


def replace_phrases_lowercasing(x: str, mapping) -> str:
    t = x
    if not mapping:
        return f"lower({x})"
    for k, v in mapping:
        t = f"replace(lower({t}), {q(k.lower())}, {q(v)})"
    return t


def remove_phrases_if_present(x: str, phrases) -> str:
    if not phrases:
        return x
    out = f"lower({x})"
    for p in phrases:
        out = f"replace({out}, {q(p.lower())}, '')"
    return f"(CASE WHEN {any_phrase(x, phrases)} THEN {out} ELSE {x} END)"


def sha(x: str) -> str:
    return f"sha256({x})"


def r6(x: str) -> str:
    return f"round({x}, 6)"
