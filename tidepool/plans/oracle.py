"""Independent DuckDB SQL for each registered query (the correctness gate).

Keys without an entry here get the driver's weaker rows-only check.
"""

from __future__ import annotations

from tidepool.operators.gates import DEFAULT_STOP_TOKENS
from tidepool.plans import params as P
from tidepool.plans import sqlviews as S
from tidepool.plans.sqlviews import q, with_views

ORACLES: dict[str, str] = {}


def _list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


POST_GATE = """
  statuses_count > 100 AND followers_count > 100 AND retweet_count < 200
  AND cast(coalesce(followers_count, 0) as double) / greatest(coalesce(friends_count, 1), 1) < 1.2
  AND cast(coalesce(followers_count, 0) as double) / greatest(coalesce(statuses_count, 1), 1) > 0.023
  AND length(full_text) > 70"""


def blocklist(x: str = "full_text", phrases=P.BLOCK_PHRASES) -> str:
    cond = f"NOT list_has_any(string_split(lower({x}), ' '), {_list(DEFAULT_STOP_TOKENS)})"
    for p in phrases:
        cond += f" AND NOT contains(lower({x}), {q(p.lower())})"
    return cond


SEARCH = (f"lang = 'en' AND NOT is_retweet AND NOT is_reply "
          f"AND list_contains({S.hashtags('full_text')}, {q(P.SEARCH_TAG)})")

TRIAGE_CANDIDATES = f"""
select post_id, author_id, full_text, sha256(full_text) as full_text_hash from posts
where {SEARCH} AND {POST_GATE}
  AND {blocklist()}
  AND {S.hashtag_ratio_ok('full_text')}
  AND sha256(full_text) NOT IN (select input_tweet_hash from replied_tweets
                                where input_tweet_hash is not null)"""

ORACLES["triage_queue"] = with_views(f"""
select post_id, author_id, full_text_hash, {q(P.SEARCH_TAG)} as hashtag
from (select *, row_number() over (partition by full_text_hash order by post_id desc) as rn
      from cand) where rn = 1
order by post_id desc limit {P.TRIAGE_N}""", "posts", "replied_tweets",
                                     extra={"cand": TRIAGE_CANDIDATES})

# ---- sources / scans --------------------------------------------------------

ORACLES["posts_search"] = with_views(
    f"select post_id, author_id, full_text from posts where {SEARCH}", "posts")

ORACLES["posts_by_ids"] = with_views(
    "select post_id, lang from posts where post_id in (select doc_id from labels where doc_id is not null)",
    "posts")

ORACLES["mentions_fingerprinted"] = with_views(
    "select mention_id, user_id, sha256(full_text) as full_text_hash from mentions", "mentions")

# ---- gates ------------------------------------------------------------------

FFRATIO = "cast(coalesce(followers_count, 0) as double) / greatest(coalesce(friends_count, 1), 1)"
FRTRATIO = "cast(coalesce(followers_count, 0) as double) / greatest(coalesce(statuses_count, 1), 1)"

ORACLES["post_metrics"] = with_views(
    f"select post_id, round({FFRATIO}, 6) as ffratio, round({FRTRATIO}, 6) as frt_ratio from posts",
    "posts")

ORACLES["post_gate"] = with_views(f"select post_id from posts where {POST_GATE}", "posts")

ORACLES["post_blocklist"] = with_views(f"select post_id from posts where {blocklist()}", "posts")

ORACLES["hashtag_ratio_gate"] = with_views(
    f"select post_id, round({S.hashtag_ratio('full_text')}, 6) as hashtag_ratio, "
    f"{S.hashtag_ratio_ok('full_text')} as passed from posts", "posts")

ORACLES["news_blocklist"] = with_views(
    "select news_id from news where " + " AND ".join(
        f"NOT contains(body, {q(w)})" for w in P.NEWS_BLOCK_WORDS), "news")

AGE_MIN = """(CASE string_split(age_text, ' ')[2]
   WHEN 'minute' THEN 1 WHEN 'minutes' THEN 1 WHEN 'hour' THEN 60 WHEN 'hours' THEN 60
   WHEN 'day' THEN 1440 WHEN 'days' THEN 1440 END) * try_cast(string_split(age_text, ' ')[1] as bigint)"""

ORACLES["news_age_filter"] = with_views(
    f"select news_id, age_minutes from (select news_id, {AGE_MIN} as age_minutes from news) "
    f"where age_minutes <= {60 * P.NEWS_MAX_AGE_HOURS}", "news")

LEX_WORDS = S.words("lower(replace(full_text, '#', ''))")
ORACLES["lexicon_flag"] = with_views(
    f"select post_id, list_has_any({LEX_WORDS}, {_list([w.lower() for w in P.LEXICON])}) as flagged, "
    f"case when list_has_any({LEX_WORDS}, {_list([w.lower() for w in P.LEXICON])}) "
    f"then 'careful' else 'default' end as mood from posts", "posts")

ORACLES["question_intent"] = """
select conv_id, turn, case when contains(lower(text), 'have questions')
  or contains(lower(text), 'have a question') then 'with an answer' else 'default' end as route
from conversations"""

ORACLES["mention_text_status"] = with_views(
    f"select mention_id, {S.remove_mentions('full_text')} as prompt_text, "
    f"case when {S.strip_ws(S.remove_mentions(S.clean_links('full_text')))} <> '' then 'ok' "
    f"else 'no text' end as status from mentions", "mentions")


def seeded_choice_sql(options, seed: str, key: str) -> str:
    """Smallest md5(seed:key:option) among the options."""
    # pairwise: option with the smallest hash (ties impossible for distinct options)
    hs = [(f"md5(concat({q(seed + ':')}, cast({key} as varchar), {q(':' + o)}))", o) for o in options]
    expr = q(hs[-1][1])
    for i in range(len(hs) - 2, -1, -1):
        h, o = hs[i]
        others = " AND ".join(f"{h} <= {h2}" for h2, _ in hs[i + 1:])
        expr = f"CASE WHEN {others} THEN {q(o)} ELSE {expr} END"
    return expr


_TERMS = _list(P.SEARCH_TERMS)
ORACLES["topic_category"] = with_views(f"""
select news_id, search_term,
  case when search_term in ('Investing', 'management', 'Finance', 'Risk', 'Economy') then 'business'
       when search_term = 'Discoveries' then {seeded_choice_sql(('general', 'technology'), P.SEED, 'news_id')}
       else 'business' end as category
from (select news_id, {_TERMS}[cast(news_id % {len(P.SEARCH_TERMS)} as int) + 1] as search_term from news)""",
                                       "news")

ORACLES["response_length_gate"] = with_views(
    "select prompt_id, attempt, cast(length(response) as int) as response_len, length(response) <= 280 as length_ok "
    "from responses", "responses")

NOT_COMPLY = "(contains(response, 'AI') AND contains(lower(response), 'i cannot'))"
PHRASE_FLAG = S.any_phrase("response", P.RESPONSE_FILTER_PHRASES)
ORACLES["response_flags"] = with_views(
    f"select prompt_id, attempt, {PHRASE_FLAG} as phrase_flag, {NOT_COMPLY} as not_comply_flag, "
    f"({PHRASE_FLAG} OR {NOT_COMPLY}) as flagged from responses", "responses")

# ---- text jobs ----------------------------------------------------------------

ORACLES["clean_posts"] = with_views(
    f"select post_id, {S.clean_post('full_text')} as clean_text from posts", "posts")

REDACTED = S.remove_phrases_if_present(S.replace_phrases_lowercasing("response", P.REDACT_MAP),
                                       P.REMOVE_PHRASES)
ORACLES["redact_phrases"] = with_views(
    f"select prompt_id, attempt, {REDACTED} as redacted from responses", "responses")

ORACLES["shorten_overlong"] = with_views(
    f"select prompt_id, attempt, {S.shorten_overlong('response', 280)} as shortened from responses",
    "responses")


def _cut_all(x: str) -> str:
    for s, e in P.CUT_MARKERS:
        x = S.cut_between_markers(x, s, e)
    return x


ORACLES["cut_between_markers"] = with_views(
    f"select prompt_id, attempt, {_cut_all('response')} as cut from responses", "responses")

_s, _e = P.EXTRACT_MARKERS
_sp = f"strpos(response, {q(_s)})"
_b = f"({_sp} + {len(_s)})"
_ep = f"(CASE WHEN strpos(substr(response, {_b}), {q(_e)}) > 0 THEN strpos(substr(response, {_b}), {q(_e)}) + {_b} - 1 ELSE 0 END)"
ORACLES["extract_between_markers"] = with_views(
    f"select prompt_id, attempt, CASE WHEN {_sp} > 0 AND {_ep} > 0 THEN "
    f"{S.strip_ws(f'substr(response, {_b}, {_ep} - {_b})')} END as extracted from responses",
    "responses")

ORACLES["trim_leading_punct"] = with_views(
    "select mention_id, regexp_replace(full_text, '^[[:punct:]]+', '') as trimmed from mentions",
    "mentions")

ORACLES["fingerprint_posts"] = with_views(
    "select post_id, sha256(full_text) as full_text_hash from posts", "posts")

ORACLES["extract_symbols"] = with_views(
    "select post_id, array_to_string(list_filter(string_split(full_text, ' '), lambda w: length(w) > 1 "
    r"AND contains(w, '$') AND NOT regexp_matches(substr(w, 2, 1), '^\p{Nd}$')), ',') as symbols from posts",
    "posts")

ORACLES["longest_hashtag"] = with_views(
    f"select * from (select prompt_id, attempt, {S.longest_hashtag('response')} as longest "
    f"from responses) where longest is not null", "responses")

ORACLES["hashtag_counts"] = with_views(
    f"select tag, count(*) as n from (select unnest({S.hashtags('full_text')}) as tag from posts) "
    f"group by tag", "posts")

ORACLES["mention_edges"] = with_views(
    "select author_id, handle, count(*) as n from (select author_id, "
    "unnest(regexp_extract_all(full_text, '@([a-zA-Z0-9_]{1,50})', 1)) as handle from posts) "
    "group by author_id, handle", "posts")

# ---- dates ------------------------------------------------------------------

ORACLES["parse_created_at"] = """
select event_id, created_at,
  cast(epoch(strptime(substr(created_at, 5), '%b %d %H:%M:%S %z %Y')) as bigint) as created_epoch
from (select event_id, strftime(ts, '%a %b %d %H:%M:%S ')
        || case when user_id % 2 = 0 then '+0000' else '+0130' end || strftime(ts, ' %Y') as created_at
      from events)"""

ORACLES["activity_by_hour"] = """
select cast(hour(ts) as int) as hour, count(*) as n from events group by 1"""

ORACLES["since_filter"] = f"""
select event_type, count(*) as n from events
where ts >= cast(cast({q(P.AS_OF)} as timestamp) as date) - interval {P.SINCE_DAYS} day
group by event_type"""

# ---- history ------------------------------------------------------------------

ORACLES["history_latest"] = with_views(
    f"select body, news_id from timeline_posts order by date desc, news_id desc limit {P.LATEST_N}", "timeline_posts")

ORACLES["history_append"] = with_views(f"""
select {q(P.RUN_TS)} as date, {q(P.SEARCH_TAG)} as hashtag, full_text as input_tweet,
  full_text_hash as input_tweet_hash, post_id as input_tweet_id,
  cast(null as varchar) as output_tweet, cast(null as varchar) as raw_model_response,
  cast(0 as bigint) as output_tweet_id, 'user_' || cast(author_id as varchar) as output_to_username,
  '200' as status
from cand""", "posts", "replied_tweets", extra={"cand": TRIAGE_CANDIDATES})

ORACLES["schema_evolve"] = with_views("""
select input_tweet_id, author_id, status, input_tweet_hash, cast(null as varchar) as date,
  cast(null as varchar) as hashtag, cast(null as varchar) as output_tweet,
  cast(null as varchar) as raw_model_response, cast(0 as bigint) as output_tweet_id,
  cast(null as varchar) as output_to_username
from replied_tweets""", "replied_tweets")

ORACLES["history_backup"] = with_views(
    "select '2024_01_02_08_01' as snapshot_ts, input_tweet_id, input_tweet_hash, status from replied_tweets",
    "replied_tweets")

ORACLES["snapshot_write"] = with_views(
    f"select post_id, author_id, {q(P.SEARCH_TAG)} as hashtag from posts where {SEARCH}", "posts")

ORACLES["fresh_snapshot"] = with_views(
    f"select post_id, {q(P.SEARCH_TAG)} as hashtag from posts where lang = 'en'", "posts")

ORACLES["snapshot_or_recompute"] = with_views(
    f"select post_id, {q(P.SEARCH_TAG)} as hashtag from posts where {SEARCH}", "posts")

ORACLES["sync_all_tables"] = with_views("""
select 'mentions' as table_name, side, in_reply_to_status_id as row_key, in_reply_to_text_hash as row_hash
from mentions_history, (select unnest(['a', 'b']) as side)
union all select 'timeline_posts', 'a', news_id, description_hash from timeline_posts
union all select 'timeline_posts', 'a', news_id, sha256(description) from news n where not exists (
  select 1 from timeline_posts h where h.news_id = n.news_id and h.description_hash = sha256(n.description))
union all select 'timeline_posts', 'b', news_id, sha256(description) from news""",
                                        "news", "timeline_posts", "mentions_history")

_COPY = """select post_id as input_tweet_id, sha256(full_text) as input_tweet_hash,
  case when post_id % 20 = 0 then null when post_id % {m} = 0 then 'changed' else 'ok' end as status from posts"""
_SAME = ("x.input_tweet_id IS NOT DISTINCT FROM y.input_tweet_id AND "
         "x.input_tweet_hash IS NOT DISTINCT FROM y.input_tweet_hash AND x.status IS NOT DISTINCT FROM y.status")
ORACLES["sync_tables"] = with_views(f"""
select 'a' as side, * from a
union all select 'a', * from b x where not exists (select 1 from a y where {_SAME})
union all select 'b', * from b
union all select 'b', * from a x where not exists (select 1 from b y where {_SAME})""",
                                    "posts", extra={
                                        "a0": _COPY.format(m=10),
                                        "a": "select * from a0 union all select * from a0 where input_tweet_id % 40 = 0",
                                        "b": _COPY.format(m=15)})

ORACLES["dim_settings"] = with_views(f"""
select d.keyword, coalesce(h.n, 0) as n_posts
from (select unnest({_list(P.KEYWORDS)}) as keyword) d
left join (select tag, count(*) as n from (select unnest(list_distinct({S.hashtags('full_text')})) as tag
           from posts) group by tag) h on h.tag = d.keyword""", "posts")

# ---- joins --------------------------------------------------------------------

ORACLES["anti_seen_hash"] = with_views("""
select post_id from posts p where not exists (
  select 1 from replied_tweets h where h.input_tweet_hash = sha256(p.full_text))""", "posts", "replied_tweets")

ORACLES["anti_seen_news"] = with_views("""
select news_id from news n
where not exists (select 1 from timeline_posts h where h.description_hash = sha256(n.description))
  and not exists (select 1 from timeline_posts h where h.input_text_url = n.url)""", "news", "timeline_posts")

ORACLES["anti_seen_mention"] = with_views("""
select mention_id from mentions m where not exists (
  select 1 from mentions_history h where h.in_reply_to_status_id = m.mention_id)""",
                                          "mentions", "mentions_history")

ORACLES["semi_exists"] = with_views("""
select post_id from posts p where exists (
  select 1 from replied_tweets h where h.input_tweet_hash = sha256(p.full_text))""", "posts", "replied_tweets")

ORACLES["mention_reply_join"] = with_views(
    "select m.mention_id, r.reply_id from mentions m join replies r on r.in_reply_to_id = m.mention_id",
    "mentions", "replies")

ORACLES["mention_replied"] = with_views("""
select m.mention_id, c.n is not null as replied, coalesce(c.n, 0) as n_replies
from mentions m left join (select in_reply_to_id, count(*) as n from replies
                           where in_reply_to_id is not null group by 1) c
  on c.in_reply_to_id = m.mention_id""", "mentions", "replies")

MENTION_BACKFILL = """
select in_reply_to_status_id, in_reply_to_text, in_reply_to_text_hash, in_reply_to_user_id,
  in_reply_to_user_name, replay_text, replay_tweet_id, status from (
  select m.mention_id as in_reply_to_status_id, m.full_text as in_reply_to_text,
    sha256(m.full_text) as in_reply_to_text_hash, m.user_id as in_reply_to_user_id, m.user_name as in_reply_to_user_name,
    r.reply_text as replay_text, r.reply_id as replay_tweet_id,
    case when c.n > 1 then 'deleted' else '200' end as status,
    row_number() over (partition by sha256(m.full_text) order by m.mention_id desc, r.reply_id desc) as rn
  from mentions m join replies r on r.in_reply_to_id = m.mention_id
  left join (select in_reply_to_id, count(*) as n from replies group by 1) c on c.in_reply_to_id = m.mention_id
  where not exists (select 1 from mentions_history h where h.in_reply_to_text_hash = sha256(m.full_text))
) where rn = 1"""
ORACLES["mention_backfill"] = with_views(MENTION_BACKFILL, "mentions", "replies", "mentions_history")

ORACLES["history_append_mentions"] = with_views(
    f"select {q(P.RUN_TS)} as date, * from ({MENTION_BACKFILL})", "mentions", "replies", "mentions_history")

ORACLES["history_append_timeline"] = with_views(f"""
select {q(P.RUN_TS)} as date, 'Finance' as search_term, cast(null as varchar) as news_date, body,
  sha256(body) as body_hash, sha256(description) as description_hash, url as input_text_url,
  cast(null as varchar) as output_text, news_id as post_tweet_id, '200' as status
from news n
where not exists (select 1 from timeline_posts h where h.description_hash = sha256(n.description))
  and not exists (select 1 from timeline_posts h where h.input_text_url = n.url)""", "news", "timeline_posts")

ORACLES["parent_lookup"] = with_views(
    "select r.reply_id, r.in_reply_to_id, m.full_text as parent_text "
    "from replies r join mentions m on r.in_reply_to_id = m.mention_id", "replies", "mentions")

# ---- aggregates / windows -------------------------------------------------------

ORACLES["duplicate_keys"] = """
select sha256(text) as text_hash, count(*) as n from documents group by 1 having count(*) > 1"""

ORACLES["multi_reply_report"] = with_views(
    "select in_reply_to_id, count(*) as n_replies from replies where in_reply_to_id is not null "
    "group by 1 having count(*) > 1", "replies")

ORACLES["keep_one_reply"] = with_views("""
select reply_id, in_reply_to_id,
  case when in_reply_to_id is null or reply_id = min(reply_id) over (partition by in_reply_to_id)
       then 'keep' else 'duplicate' end as action
from replies""", "replies")

_FINAL = S.shorten_overlong(
    S.remove_phrases_if_present(S.replace_phrases_lowercasing(_cut_all("response"), P.REDACT_MAP),
                                P.REMOVE_PHRASES), 280)
FIRST_ACCEPTED = f"""
select prompt_id, min(attempt) filter (where ok) as accepted_attempt,
  arg_min(final, attempt) filter (where ok) as final_response, count(*) as n_attempts,
  case when min(attempt) filter (where ok) is null then 'not_passed' else 'passed' end as status
from (select prompt_id, attempt, f as final,
        (NOT flagged) AND length(f) <= 280 AND attempt <= {P.MAX_ATTEMPTS} as ok
      from (select prompt_id, attempt, {_FINAL} as f, ({PHRASE_FLAG} OR {NOT_COMPLY}) as flagged
            from responses))
group by prompt_id"""
ORACLES["first_accepted_attempt"] = with_views(FIRST_ACCEPTED, "responses")

ORACLES["seeded_pick"] = with_views(f"""
select feed, arg_min(news_id, md5({q(P.SEED + ':')} || cast(news_id as varchar))) as news_id
from news group by feed""", "news")

ORACLES["topic_fallback"] = with_views(f"""
select post_id, topic from g where topic = (
  select topic from (select topic, count(*) as n from g group by topic) where n > 0
  order by topic <> {q(P.FALLBACK_TOPIC)}, md5({q(P.SEED + ':')} || topic) limit 1)""",
                                       "posts", extra={"g": f"""
select post_id, regexp_extract(full_text, '#(topic[0-9]+)', 1) as topic from posts
where {POST_GATE} AND {blocklist()}"""})

ORACLES["response_audit"] = with_views(f"""
select attempt, count(*) as n, cast(count_if({PHRASE_FLAG} OR {NOT_COMPLY}) as bigint) as n_flagged,
  cast(count_if({NOT_COMPLY}) as bigint) as n_not_comply, round(avg(length(response)), 6) as avg_len,
  cast(max(length(response)) as int) as max_len
from responses group by attempt""", "responses")

# ---- chat logs ------------------------------------------------------------------

_PROMPTS = "select conv_id as prompt_id, arg_min(text, turn) as prompt from conversations where role = 'user' group by 1"
_SETUP = "".join(f" union all select prompt_id, {i}, {q(r)}, {q(c)} from prompts" for i, (r, c) in enumerate(P.SETUP_TURNS, 1))
CHAT_LOG = f"""select prompt_id, 0 as position, 'system' as role, {q(P.SYSTEM_TEXT)} as content from prompts{_SETUP}
union all select prompt_id, {len(P.SETUP_TURNS) + 1}, 'user', {S.clean_links('prompt')} from prompts"""
ORACLES["chat_log_build"] = with_views(CHAT_LOG, extra={"prompts": _PROMPTS})

ORACLES["chat_log_append"] = f"""
select conv_id, turn as position, role, text as content from conversations where turn <= 1
union all
select c.conv_id, coalesce(h.last, -1) + 1 + c.turn - 2, c.role, {S.clean_links('c.text')}
from conversations c
left join (select conv_id, max(turn) as last from conversations where turn <= 1 group by 1) h on h.conv_id = c.conv_id
where c.turn > 1"""

_SETTINGS = ", ".join(f"{v if isinstance(v, float) else q(v)} as {k}" for k, v in P.LOG_SETTINGS.items())
_SETTINGS = _SETTINGS.replace("0.7 as temperature", "cast(0.7 as double) as temperature")
LOG_RECORD = f"""
select p.prompt_id, {S.clean_links('p.prompt')} as question, {q(P.SYSTEM_TEXT)} as prompt,
  f.final_response as response, f.status as filter, {_SETTINGS}
from prompts p join first_ok f on f.prompt_id = p.prompt_id"""
ORACLES["response_log_record"] = with_views(LOG_RECORD, "responses", extra={"prompts": _PROMPTS, "first_ok": FIRST_ACCEPTED})
ORACLES["history_append_ai_params"] = with_views(
    f"select {q(P.RUN_TS)} as date, * exclude (prompt_id) from ({LOG_RECORD})", "responses",
    extra={"prompts": _PROMPTS, "first_ok": FIRST_ACCEPTED})

# ---- similarity -----------------------------------------------------------------

ORACLES["term_frequencies"] = f"""
select doc_id, token, count(*) as tf
from (select doc_id, unnest({S.tokens('text')}) as token from documents) group by doc_id, token"""


def _tv(name: str, id_expr: str, text: str, src: str) -> str:
    return (f"select {id_expr} as {name}, tok, count(*) as tf from "
            f"(select {id_expr}, unnest({S.tokens(text)}) as tok from {src}) group by all")


def _cos(dot: str, a: str, b: str) -> str:
    den = f"(sqrt(cast({a} as double)) * sqrt(cast({b} as double)))"
    return f"(CASE WHEN {den} > 0 THEN cast({dot} as double) / {den} ELSE 0.0 END)"


ORACLES["cosine_score"] = with_views(f"""
select p.a as reply_id, p.b as mention_id,
  round({_cos('coalesce(d.dot, 0)', 'coalesce(na.n2, 0)', 'coalesce(nb.n2, 0)')}, 6) as cosine
from p left join d on d.a = p.a and d.b = p.b
left join na on na.a = p.a left join nb on nb.b = p.b""", "replies", "mentions", extra={
    "p": "select distinct reply_id as a, in_reply_to_id as b from replies",
    "ta": _tv("a", "reply_id", "reply_text", "replies"),
    "tb": _tv("b", "mention_id", "full_text", "mentions"),
    "na": "select a, sum(tf * tf) as n2 from ta group by a",
    "nb": "select b, sum(tf * tf) as n2 from tb group by b",
    "d": "select p.a, p.b, sum(ta.tf * tb.tf) as dot from p join ta on ta.a = p.a "
         "join tb on tb.b = p.b and tb.tok = ta.tok group by p.a, p.b"})

ORACLES["near_dup_vs_latest"] = with_views(f"""
select news_id from news where news_id not in (
  select c.c from d join cn c on c.c = d.c join hn h on h.h = d.h
  where {_cos('d.dot', 'c.n2', 'h.n2')} > {P.NEAR_DUP_MAX_COS})""", "news", "timeline_posts", extra={
    "hist": f"select news_id, body from timeline_posts order by date desc, news_id desc limit {P.LATEST_N}",
    "htv": _tv("h", "news_id", "body", "hist"),
    "hn": "select h, sum(tf * tf) as n2 from htv group by h",
    "ctv": _tv("c", "news_id", "body", "news"),
    "cn": "select c, sum(tf * tf) as n2 from ctv group by c",
    "d": "select ctv.c, htv.h, sum(ctv.tf * htv.tf) as dot from ctv join htv on ctv.tok = htv.tok "
         "group by ctv.c, htv.h"})

ORACLES["near_dup_pairs"] = with_views(f"""
select d.a as a_id, d.b as b_id, round({_cos('d.dot', 'na.n2', 'nb.n2')}, 6) as cosine,
  ra.copies as a_copies, rb.copies as b_copies
from d join n na on na.rep = d.a join n nb on nb.rep = d.b
join reps ra on ra.rep = d.a join reps rb on rb.rep = d.b
where {_cos('d.dot', 'na.n2', 'nb.n2')} >= {P.PAIR_MIN_COS}""", extra={
    "reps": "select sha256(text) as h, min(doc_id) as rep, count(*) as copies, arg_min(text, doc_id) as t "
            "from documents where text is not null group by 1",
    "tv": _tv("rep", "rep", "t", "reps"),
    "n": "select rep, sum(tf * tf) as n2 from tv group by rep",
    "d": "select x.rep as a, y.rep as b, sum(x.tf * y.tf) as dot from tv x join tv y "
         "on x.tok = y.tok and x.rep < y.rep group by 1, 2"})

ORACLES["near_dup_members"] = """
select doc_id, case when text is not null then min(doc_id) over (partition by text) end as rep from documents"""

# ---- news ---------------------------------------------------------------------

_BASE = f"""select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
  {S.PAGE_TEXT} as para,
  cast(1 + page_id % 30 as varchar) || case page_id % 3 when 0 then ' minutes ago'
    when 1 then ' hours ago' else ' days ago' end as age
from pages"""
_ART = """select url, title, case when para <> '' then para end as description,
  printf('2024-01-%02d', cast(1 + page_id % 28 as int)) as published_at from base where page_id % 3 = 2"""
_NULLS = "cast(null as varchar)"
ORACLES["news_normalized"] = with_views(f"""
select 'news_search' as feed, url, {_NULLS} as title, {_NULLS} as description, para as body,
  {_NULLS} as published_at, {_NULLS} as age_text, 'Finance' as search_term, sha256(para) as body_hash,
  {_NULLS} as description_hash from base where page_id % 3 = 0
union all
select 'news_snippets', url, {_NULLS}, {_NULLS}, para, {_NULLS}, age, 'Finance', sha256(para), {_NULLS}
from base where page_id % 3 = 1
union all
select 'news_articles', url, title, description, string_split(title, ' -')[1] || '. ' || description,
  published_at, {_NULLS}, 'Finance', {_NULLS}, sha256(description)
from art where description is not null""", extra={"base": _BASE, "art": _ART})

ORACLES["news_feed_choice"] = with_views(f"""
select 'news_snippets' as feed, url, term as search_term, age_text, sha256(para) as body_hash
from young where term = (select term from (select distinct term from young)
  order by term <> {q(P.FALLBACK_TOPIC)}, md5({q(P.SEED + ':')} || term) limit 1)""", extra={
    "base": _BASE, "young": f"""select * from (
  select *, age as age_text, {_TERMS}[cast(length(para) % {len(P.SEARCH_TERMS)} as int) + 1] as term from base) where {AGE_MIN} <= {60 * P.NEWS_MAX_AGE_HOURS}"""})

ORACLES["news_union"] = with_views("""
select 'top_headlines' as feed, url, 'Finance' as search_term, sha256(description) as description_hash
from art where description is not null
union all
select 'all_articles', url, 'Finance', sha256(description) from art
where description is not null""", extra={"base": _BASE, "art": _ART.replace(" where page_id % 3 = 2", "")})

# ---- reports, nested fields ----------------------------------------------------------

_TEMPS = "[" + ", ".join(str(x) for x in P.TEMPERATURES) + "]"
ORACLES["response_report"] = with_views(f"""
select prompt_id, attempt,
  coalesce(case when response is not null and response <> '' then
    'Model Response: ' || response || chr(10) || 'Response Len: ' || cast(length(response) as varchar) || chr(10)
    end, '')
  || coalesce(case when mood is not null and mood <> '' then 'Mood: ' || mood || chr(10) end, '')
  || coalesce(case when temperature is not null and temperature <> 0 then
       'Temp: ' || cast(temperature as varchar) || chr(10) end, '')
  || coalesce(case when model is not null and model <> '' then 'Model: ' || model || chr(10) end, '')
  || '-------------------------------' as report
from (select prompt_id, attempt, response,
        {_TEMPS}[cast(attempt % {len(P.TEMPERATURES)} as int) + 1] as temperature,
        case when prompt_id % 2 = 0 then {q(P.LOG_SETTINGS['model'])} end as model,
        case when prompt_id % 3 = 0 then 'curious' end as mood
      from responses)""", "responses")

ORACLES["post_flatten"] = with_views("""
select post_id, author_id as user_id, 'user_' || cast(author_id as varchar) as screen_name,
  coalesce(case when post_id % 7 <> 0 then followers_count end, 0) as followers,
  coalesce(case when post_id % 9 <> 0 then friends_count end, 1) as friends,
  coalesce(statuses_count, 1) as statuses
from posts""", "posts")

ORACLES["event_props"] = """
select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"""

# ---- streaming (compared on the sink after all files are processed) -------------------

ORACLES["stream_length_gate"] = with_views(
    f"select mention_id, case when length({S.clean_links('full_text')}) > {P.STREAM_MIN_LEN} then 'long' else 'short' end "
    f"as route from mentions", "mentions")

ORACLES["stream_triage"] = with_views("""
select post_id, author_id, full_text_hash from (
  select *, row_number() over (partition by full_text_hash order by post_id % 3, post_id) as rn from g) where rn = 1""",
                                      "posts", "replied_tweets", extra={"g": f"""
select post_id, author_id, sha256(full_text) as full_text_hash from posts
where {POST_GATE} AND {blocklist()} AND {S.hashtag_ratio_ok('full_text')}
  AND NOT EXISTS (select 1 from replied_tweets h where h.input_tweet_hash = sha256(posts.full_text))"""})

ORACLES["stream_mentions"] = with_views(f"""
select mention_id as in_reply_to_status_id, sha256(full_text) as in_reply_to_text_hash,
  case when {S.strip_ws(S.remove_mentions(S.clean_links('full_text')))} <> '' then 'ok' else 'no text' end as status
from mentions m where not exists (
  select 1 from mentions_history h where h.in_reply_to_status_id = m.mention_id)""", "mentions", "mentions_history")

ORACLES["stream_dedup"] = "select event_id, user_id, event_type, value from events"


_NO_BLOCKED = " AND ".join(f"NOT contains(body, {q(w)})" for w in P.STREAM_BLOCK_WORDS)


def _stream_news_sql(n_batches: int = 3) -> str:
    """The news loop unrolled: batch b holds the news with news_id % n = b
    (files are staged in that order); each batch sees the history plus the
    picks of earlier batches."""
    ctes = {"h0": "select date, news_id, body, description_hash, input_text_url from timeline_posts"}
    for b in range(n_batches):
        posted = " union all ".join(
            ["select * from h0"] + [f"select timestamp {q(P.FIRST_ROUND)} + to_hours({i}) as date, "
                                    f"news_id, body, dh as description_hash, url as input_text_url "
                                    f"from pick{i}" for i in range(b)])
        ctes[f"posted{b}"] = posted
        ctes[f"cand{b}"] = (f"select news_id, body, sha256(description) as dh, url from news "
                            f"where news_id % {n_batches} = {b} and {_NO_BLOCKED} and {AGE_MIN} <= {60 * P.STREAM_MAX_AGE_HOURS}")
        ctes[f"latest{b}"] = f"select news_id, body from posted{b} order by date desc, news_id desc limit {P.LATEST_N}"
        ctes[f"htv{b}"] = _tv("h", "news_id", "body", f"latest{b}")
        ctes[f"hn{b}"] = f"select h, sum(tf * tf) as n2 from htv{b} group by h"
        ctes[f"ctv{b}"] = _tv("c", "news_id", "body", f"cand{b}")
        ctes[f"cn{b}"] = f"select c, sum(tf * tf) as n2 from ctv{b} group by c"
        ctes[f"near{b}"] = (
            f"select d.c from (select ctv{b}.c, htv{b}.h, sum(ctv{b}.tf * htv{b}.tf) as dot "
            f"from ctv{b} join htv{b} on ctv{b}.tok = htv{b}.tok group by ctv{b}.c, htv{b}.h) d "
            f"join cn{b} c on c.c = d.c join hn{b} h on h.h = d.h "
            f"where {_cos('d.dot', 'c.n2', 'h.n2')} > {P.NEAR_DUP_MAX_COS}")
        ctes[f"pick{b}"] = (
            f"select news_id, body, dh, url from cand{b} k "
            f"where news_id not in (select c from near{b}) "
            f"and not exists (select 1 from posted{b} p where p.description_hash = k.dh) "
            f"and not exists (select 1 from posted{b} p where p.input_text_url = k.url) "
            f"order by md5({q(P.SEED + ':')} || cast({b} as varchar) || ':' || cast(news_id as varchar)), "
            f"news_id limit 1")
    body = " union all ".join(f"select {b} as batch_id, news_id from pick{b}" for b in range(n_batches))
    return with_views(body, "news", "timeline_posts", extra=ctes)


ORACLES["stream_news"] = _stream_news_sql()
ORACLES["stream_dedup_bounded"] = "select event_id, user_id, event_type from events"
ORACLES["stream_mentions_lookup"] = ORACLES["stream_mentions"]
_STORE = """select post_id as input_tweet_id, sha256(full_text) as input_tweet_hash,
  case when post_id % 20 <> 0 then 'ok' end as status from posts"""
ORACLES["sync_digest"] = with_views("""
select 'a' as side, * from store where input_tweet_id % 500 = 3
union all select 'b', * from store where input_tweet_id % 500 = 7
union all select 'b', * from store where input_tweet_id % 1000 = 7""", "posts", extra={"store": _STORE})
ORACLES["snapshot_cached"] = with_views(
    "select post_id, case when lang = 'en' then 'cached' else 'fetched' end as hashtag from posts where lang is not null", "posts")
_NEAR = {
    "reps": "select sha256(text) as h, min(doc_id) as rep, arg_min(text, doc_id) as t from documents where text is not null group by 1",
    "tv": _tv("rep", "rep", "t", "reps"),
    "n": "select rep, sum(tf * tf) as n2 from tv group by rep",
    "d": "select x.rep as a, y.rep as b, sum(x.tf * y.tf) as dot from tv x join tv y on x.tok = y.tok and x.rep <> y.rep group by 1, 2",
    "s": f"select d.a, d.b, {_cos('d.dot', 'na.n2', 'nb.n2')} as cosine from d join n na on na.rep = d.a join n nb on nb.rep = d.b",
    "e": f"select a, b from s where cosine >= {P.PAIR_MIN_COS}",
    "reach": "(select a, a as b from e union select a, b from e) union select r.a, e.b from reach r join e on e.a = r.b",
    "k": "select a as rep, min(b) as class from reach group by a",
    "l": "select a as rep, count(*) as links from e group by a"}
ORACLES["near_dup_classes"] = with_views("""
select m.doc_id, m.rep, coalesce(k.class, m.rep) as class,
  round(case when m.rep is null then null when coalesce(k.class, m.rep) = m.rep then 1.0 else coalesce(s.cosine, 0.0) end, 6) as cosine,
  case when m.rep is not null then coalesce(l.links, 0) end as links
from (select doc_id, case when text is not null then min(doc_id) over (partition by text) end as rep from documents) m
left join k on k.rep = m.rep left join l on l.rep = m.rep left join s on s.a = m.rep and s.b = k.class""",
                                        extra=_NEAR).replace("WITH ", "WITH RECURSIVE ", 1)
for _key in ("anti_seen_hash", "anti_seen_news", "anti_seen_mention", "semi_exists"):
    ORACLES[f"{_key}_indexed"] = ORACLES[_key]

_LOW = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}_]+)')"
_LONGEST = max(n for _, n in P.PHRASE_CUTS)
ORACLES["phrase_hits"] = with_views("""
select post_id, count(distinct phrase) as n_phrases, count(*) as n_places, cast(min(pos) as bigint) as first_position
from grams join phrases using (phrase) group by post_id""", "posts", extra={
    "phrases": "select distinct phrase from (" + " union all ".join(
        f"select array_to_string(list_slice({_LOW.format('text')}, {at}, {at + n - 1}), ' ') as phrase from documents"
        for at, n in P.PHRASE_CUTS) + ") where phrase <> ''",
    "words": f"select post_id, unnest(w) as w0, generate_subscripts(w, 1) - 1 as pos from "
             f"(select post_id, {_LOW.format('full_text')} as w from posts)",
    "ahead": "select post_id, pos, w0" + "".join(f", lead(w0, {i}) over o as w{i}" for i in range(1, _LONGEST))
             + " from words window o as (partition by post_id order by pos)",
    "grams": " union all ".join("select post_id, pos, " + " || ' ' || ".join(f"w{i}" for i in range(n)) + " as phrase from ahead"
                                for n in range(1, _LONGEST + 1))})
ORACLES["news_feed_search"] = with_views(
    "select 'news_search' as feed, url, 'Finance' as search_term, sha256(para) as body_hash from base", extra={"base": _BASE})
ORACLES["history_latest_pruned"] = ORACLES["history_latest"]
