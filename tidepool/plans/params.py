"""Parameters of the registered queries, shared by the Spark plans and their
SQL oracles so both sides always run the same job.

Lexicons, phrase lists and maps are *caller-supplied* in the library; the
values below are the caller's choices for the registered queries (neutral
words chosen so each gate both keeps and drops rows on the fixtures).
"""

SEARCH_TAG = "topic3"          # posts_search / triage_queue
TRIAGE_N = 5                   # posts accepted per round
LATEST_N = 10                  # near-dup window (last n timeline bodies)
NEAR_DUP_MAX_COS = 0.45        # keep a candidate only if cos <= this vs all latest
PAIR_MIN_COS = 0.9             # near_dup_pairs threshold
RUN_TS = "2024-01-02 03:04:05"  # the job's run timestamp (history 'date')
AS_OF = "2024-01-08 00:00:00"  # "today" for since/age filters
BACKUP_AS_OF = "2024-01-02 08:01:00"
SEED = "round-1"
NEWS_MAX_AGE_HOURS = 8
SINCE_DAYS = 3

BLOCK_PHRASES = ("#trend_1#deal",)
LEXICON = ("giveaway", "airdrop", "cat dog")
NEWS_BLOCK_WORDS = ("Thheouble", "Nicht")
RESPONSE_FILTER_PHRASES = ("as an ai", "i cannot follow", "my programming", "sorry, i cannot")
# not-comply rule: "AI" (case-sensitive) together with "i cannot" (any case)
REDACT_MAP = (("#sarcasm", "#nooffense"), ("#grumpy", ""), ("#sarcastic", ""), ("#motivation", ""))
REMOVE_PHRASES = ("respectfully ", "it is important to ", "possible response:", "thanks for sharing")
CUT_MARKERS = (("As an AI", "#"), ("Let's", "#"))
SEARCH_TERMS = ("Investing", "Money", "management", "Finance", "Risk management", "Economy",
                "Discoveries")
KEYWORDS = ("topic1", "topic3", "Trend_1", "deal", "bitcoin")
MAX_ATTEMPTS = 3
EXTRACT_MARKERS = ("As an AI", ".")
FALLBACK_TOPIC = "topic9"   # not present: exercises the fallback branch
# Chat-log template supplied by the caller (neutral wording).
SYSTEM_TEXT = "You are a helpful assistant."
SETUP_TURNS = (("user", "Reply in at most 280 characters; answer OK when ready."),
               ("assistant", "OK"))
LOG_SETTINGS = {"model": "model-a", "temperature": 0.7, "ability": "reply_to_mentions",
                "personality": "plain", "nuance": "short", "mood": "default", "rules": "none"}
RUN_ID = "job-1"                # names the run in the history's partition
FIRST_ROUND = "2024-01-08 00:00:00"   # news rounds post hourly from here on
TEMPERATURES = (0.7, 0.8, 0.9, 1.0)
STREAM_MIN_LEN = 300             # stream_length_gate
STREAM_BLOCK_WORDS = ("Thheouble",)   # stream_news
STREAM_MAX_AGE_HOURS = 24 * 15
PHRASE_CUTS = ((1, 2), (3, 3), (6, 4), (10, 5), (15, 6))   # (first word, words) of a document's phrases
