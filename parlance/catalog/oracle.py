"""DuckDB SQL for the registered queries, written from the rules and not from the Spark code."""

from __future__ import annotations

from parlance.catalog.fixtures import MARKER, NARROW_SPACE, NOTICE_TEXT, SPECIAL
from parlance.catalog.queries import STOP_WORDS, WORD_TABLE
from parlance.functions.emoji import ITEM
from parlance.functions.text import SPACE_CHARS, SPACE_CLASS
from parlance.resources.phrases import ABBREVIATIONS, PHRASES
from parlance.schema import EMOTIONS, LANGUAGES, TOXICITY_LABELS

ORACLE: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def rows(pairs) -> str:
    return ", ".join("(" + ", ".join(text(v) for v in pair) + ")" for pair in pairs)


def words(column: str) -> str:
    split = f"string_split_regex({column}, {text(SPACE_CLASS + '+')})"
    return f"list_filter({split}, lambda t: t <> '')"


def stripped(column: str) -> str:
    return f"trim({column}, {text(SPACE_CHARS)})"


MESSAGES = """
k AS (SELECT conv_id, count(DISTINCT role) AS n, min(role) AS a, max(role) AS b
      FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, turn, role, text, 0 AS extra, 'text' AS typ FROM conversations
      UNION ALL
      SELECT conv_id, turn, role, NULL, 1, ['image', 'audio', 'deleted_by_others'][(conv_id*7 + turn*3) % 13 + 1]
      FROM conversations WHERE (conv_id*7 + turn*3) % 13 < 3),
messages AS (
SELECT t.conv_id AS chat_id, t.turn * 2 + extra AS seq, t.role AS sender,
 CASE WHEN k.n > 2 THEN 'group' WHEN k.n = 2 THEN CASE WHEN t.role = k.a THEN k.b ELSE k.a END END
   AS receiver,
 CASE WHEN typ = 'text' THEN lower(trim(t.text)) ||
   CASE (t.conv_id + t.turn) % 6 WHEN 0 THEN ' brb! sorry 😂😂' WHEN 1 THEN ' this is so cool 👍'
   WHEN 2 THEN ' asap, damn' WHEN 3 THEN ' why 😂 http://x.io/a' ELSE '' END END AS content,
 TIMESTAMP '2024-01-01 00:00:00' + ((t.conv_id % 90) * 1440 + (t.conv_id * 37) % 1440 + t.turn * 10
   + CASE WHEN t.turn >= 3 THEN (t.conv_id % 7) * 50 ELSE 0 END
   + CASE WHEN t.turn >= 5 THEN (t.conv_id % 3) * 235 ELSE 0 END
   + CASE WHEN t.turn >= 7 THEN (t.conv_id % 4) * 300 ELSE 0 END + extra) * INTERVAL '1' MINUTE AS ts,
 typ AS type
FROM t JOIN k ON t.conv_id = k.conv_id)"""

CALLS = """
calls AS (
SELECT event_id AS seq, user_id % 3 AS chat_id, 'u' || CAST(user_id % 20 AS VARCHAR) AS sender,
 'u' || CAST((user_id + 1 + event_id % 3) % 20 AS VARCHAR) AS receiver,
 CASE WHEN event_type IN ('signup','purchase') THEN CAST(floor(value) AS BIGINT) ELSE 0 END
   AS duration,
 CASE event_type WHEN 'signup' THEN 'voice_call' WHEN 'purchase' THEN 'video_call'
   WHEN 'view' THEN 'missed_voice_call' WHEN 'click' THEN 'missed_video_call'
   ELSE 'silenced_voice_call' END AS type,
 CASE WHEN extract(day FROM ts) % 7 = 3 THEN ts - INTERVAL '1' DAY ELSE ts END AS ts FROM events)"""

SCORED = MESSAGES + """,
scored AS (
SELECT chat_id % 3 AS chat_id, chat_id AS src, seq, sender, receiver, content AS merged_content,
 CAST(ts AS DATE) AS date, ts,
 CASE (chat_id*3 + seq) % 5 WHEN 0 THEN 'Very Negative' WHEN 1 THEN 'Negative' WHEN 2 THEN 'Neutral'
   WHEN 3 THEN 'Positive' ELSE 'Very Positive' END AS sentiment,
 (chat_id*3 + seq) % 5 - 2 AS mood,
 CAST((chat_id*17 + seq*29) % 100 AS DOUBLE) / 100 AS tox_score,
 CASE WHEN (chat_id*17 + seq*29) % 100 > 50 THEN CASE (chat_id + seq) % 3 WHEN 0 THEN 'insult'
   WHEN 1 THEN 'threat' ELSE 'obscene' END END AS tox_type
FROM messages WHERE content IS NOT NULL),
emotions_long AS (
SELECT m.chat_id % 3 AS chat_id, m.chat_id AS src, m.seq, CAST(m.ts AS DATE) AS date, m.sender, k.i,
 CASE (m.chat_id + m.seq*2 + k.i) % 8 WHEN 0 THEN 'love' WHEN 1 THEN 'caring' WHEN 2 THEN 'anger'
   WHEN 3 THEN 'annoyance' WHEN 4 THEN 'joy' WHEN 5 THEN 'sadness' WHEN 6 THEN 'neutral'
   ELSE 'fear' END AS emotion, k.score
FROM messages m CROSS JOIN (VALUES (0, CAST(0.7 AS DOUBLE)), (1, CAST(0.2 AS DOUBLE)),
  (2, CAST(0.0005 AS DOUBLE))) AS k(i, score) WHERE m.content IS NOT NULL)"""


def _lines(name: str, prefix: str, notice: str, extra: str) -> str:
    return f"""
{name} AS (
WITH head AS (SELECT *, {prefix} AS prefix, {prefix} || sender || ': ' AS head,
   coalesce(content, {text(MARKER)} || type || ' omitted') AS body FROM messages),
pieces AS (SELECT chat_id, seq, list_filter(list_concat(
   [CASE WHEN seq = 0 THEN {notice} END], string_split(head || body, chr(10)),
   [head || {extra}, CASE WHEN (chat_id + seq) % 5 = 0 THEN 'and a second line: more' END]),
   lambda x: x IS NOT NULL) AS p FROM head)
SELECT chat_id, seq * 1000 + generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS line FROM pieces)"""


GOLDEN = f"list_extract({texts(SPECIAL)}, CAST((chat_id*5 + seq) % 29 + 1 AS BIGINT))"
LINES_IOS = MESSAGES + "," + _lines(
    "lines_ios",
    "'[' || strftime(ts, '%d/%m/%y, %-I:%M:%S %p') || '] '",
    f"prefix || CASE WHEN chat_id % 2 = 0 THEN 'Desk' ELSE sender END || ': ' || {text(NOTICE_TEXT)}",
    GOLDEN,
)
LINES_ANDROID = MESSAGES + "," + _lines(
    "lines_android",
    f"strftime(ts, '%d/%m/%y, %-I:%M') || {text(NARROW_SPACE)} || lower(strftime(ts, '%p')) || ' - '",
    text(NOTICE_TEXT),
    f"CASE WHEN (chat_id + seq) % 4 = 0 THEN '<Media omitted>' ELSE {GOLDEN} END",
)

# The line and content patterns of the export formats, one pattern per rule.
IOS = r"^\[(\d{2}/\d{2}/\d{2}), (\d{1,2}:\d{2}:\d{2} [APM]{2})\] (.*?): (.*)"
PERSON = r"^\[.*\] (.+?): .*"
ANDROID = r"^(\d{2}/\d{2}/\d{2})," + SPACE_CLASS + r"(\d{1,2}:\d{1,2}).([ap]m) - (.*?): (.*)"
LINK = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
COMPLETED = r"(voice call|video call), \d (min|sec|h)"
MISSED = r"missed (voice|video) call"
UNANSWERED = r"(voice|video) call, no answer"
FAILED = r"call failed, try again"
GROUP = r"group call, \d invited"
SILENCED = r"(silenced voice call|silenced video call), (.+)$"
ATTACHED = r"(image|audio|video|gif|sticker|contact card|video note) omitted"
WHERE_AT = r"location: (.+)$"
EDITED = r"(.+) <this message was edited>$"


def unlinked(column: str) -> str:
    first = f"regexp_extract({column}, {text(LINK)})"
    return f"CASE WHEN {first} <> '' THEN replace({column}, {first}, '') ELSE {column} END"


def _has(pattern: str) -> str:
    return f"regexp_matches(content, {text(pattern)})"


def _people(source: str) -> str:
    return f"""
k2 AS (SELECT chat_id, count(*) AS n, min(p) AS a, max(p) AS b FROM {source} GROUP BY chat_id)"""


RECEIVER = """CASE WHEN k2.n > 2 THEN 'group' WHEN k2.n = 2 THEN
  CASE WHEN m.sender = k2.a THEN k2.b ELSE k2.a END END"""

PARSED_IOS = LINES_IOS + f""",
people AS (SELECT DISTINCT chat_id, regexp_extract(c, {text(PERSON)}, 1) AS p
  FROM (SELECT chat_id, {stripped(f"replace(line, {text(MARKER)}, '')")} AS c FROM lines_ios)
  WHERE regexp_matches(c, {text(PERSON)})),
{_people("people")},
raw AS (SELECT chat_id, seq, replace({stripped("line")}, {text(MARKER)}, '') AS l FROM lines_ios),
m AS (SELECT * FROM (SELECT chat_id, seq, regexp_extract(l, {text(IOS)}, 3) AS sender,
  lower({stripped(f"regexp_extract(l, {text(IOS)}, 4)")}) AS content,
  strptime(regexp_extract(l, {text(IOS)}, 1) || ' ' || regexp_extract(l, {text(IOS)}, 2),
    '%d/%m/%y %I:%M:%S %p') AS ts
  FROM raw WHERE regexp_matches(l, {text(IOS)})) WHERE content <> lower({text(NOTICE_TEXT)})),
typed AS (SELECT *,
  CASE WHEN {_has(COMPLETED)} THEN replace(regexp_extract(content, 'voice call|video call'), ' ', '_')
   WHEN {_has(MISSED)} THEN
     replace(regexp_extract(content, 'missed voice call|missed video call'), ' ', '_')
   WHEN {_has(UNANSWERED)} THEN 'missed_' || regexp_extract(content, {text(UNANSWERED)}, 1) || '_call'
   WHEN {_has(FAILED)} THEN 'failed_call'
   WHEN {_has(GROUP)} THEN 'group_call'
   WHEN {_has(SILENCED)} THEN
     replace(regexp_extract(content, 'silenced voice call|silenced video call'), ' ', '_')
  END AS call_type FROM m),
kinds AS (SELECT *,
  CASE WHEN {_has(ATTACHED)} THEN replace(
     regexp_extract(content, 'image|audio|video|gif|sticker|contact card|video note'), ' ', '_')
   WHEN {_has(WHERE_AT)} THEN 'location'
   WHEN {_has(".* document omitted$")} THEN 'document'
   WHEN {_has(r"you deleted this message[.]$")} THEN 'deleted_by_me'
   WHEN {_has(r"this message was deleted[.]$")} THEN 'deleted_by_others'
   WHEN {_has("you blocked this contact$")} THEN 'blocked'
   WHEN {_has("you unblocked this contact$")} THEN 'unblocked'
   WHEN {_has(EDITED)} THEN 'text_edited_message' ELSE 'text' END AS type
  FROM typed WHERE call_type IS NULL),
shown AS (SELECT chat_id, seq, sender, ts, type, CASE type
   WHEN 'text' THEN content
   WHEN 'location' THEN {unlinked(f"regexp_extract(content, {text(WHERE_AT)}, 1)")}
   WHEN 'document' THEN {unlinked("content")}
   WHEN 'text_edited_message' THEN {unlinked(f"regexp_extract(content, {text(EDITED)}, 1)")}
  END AS content FROM kinds)"""

ORACLE["scan_lines"] = f"""WITH {LINES_IOS}
SELECT 'chat-' || chat_id AS chat_id,
 row_number() OVER (PARTITION BY chat_id ORDER BY seq) - 1 AS seq, line FROM lines_ios"""
ORACLE["scan_zip"] = ORACLE["scan_lines"]

ORACLE["csv_roundtrip"] = f"""WITH {SCORED}
SELECT s.chat_id, s.src, s.seq, s.sender, s.merged_content, s.date, s.ts, s.sentiment,
 e.emotions, s.tox_score, s.tox_type
FROM scored s JOIN (SELECT src, seq, string_agg(emotion, ', ' ORDER BY i) AS emotions
  FROM emotions_long WHERE score > 0.001 GROUP BY src, seq) e USING (src, seq)"""
ORACLE["json_roundtrip"] = ORACLE["csv_roundtrip"]

ORACLE["parse_ios"] = f"""WITH {PARSED_IOS}
SELECT m.chat_id, m.seq, m.sender, {RECEIVER} AS receiver, m.content, m.ts, m.type
FROM shown m LEFT JOIN k2 ON m.chat_id = k2.chat_id"""

ORACLE["parse_android"] = f"""WITH {LINES_ANDROID},
raw AS (SELECT chat_id, seq, {stripped("line")} AS l FROM lines_android),
m0 AS (SELECT chat_id, seq, regexp_extract(l, {text(ANDROID)}, 4) AS sender,
  lower({stripped(f"regexp_extract(l, {text(ANDROID)}, 5)")}) AS content,
  strptime(regexp_extract(l, {text(ANDROID)}, 1) || ' ' || regexp_extract(l, {text(ANDROID)}, 2)
    || ' ' || regexp_extract(l, {text(ANDROID)}, 3), '%d/%m/%y %I:%M %p') AS ts
  FROM raw WHERE regexp_matches(l, {text(ANDROID)})),
people AS (SELECT DISTINCT chat_id, sender AS p FROM m0), {_people("people")},
m AS (SELECT *, CASE WHEN regexp_matches(content, '<media omitted>$') THEN 'media'
  WHEN content <> '' THEN 'text' ELSE 'unknown' END AS type FROM m0)
SELECT m.chat_id, m.seq, m.sender, {RECEIVER} AS receiver,
 CASE WHEN m.type = 'text' THEN m.content END AS content, m.ts, m.type
FROM m LEFT JOIN k2 ON m.chat_id = k2.chat_id"""

ORACLE["participants"] = f"WITH {PARSED_IOS} SELECT chat_id, p AS participant FROM people"
ORACLE["receiver"] = f"""WITH {PARSED_IOS}
SELECT m.chat_id, m.seq, m.sender, {RECEIVER} AS receiver
FROM m LEFT JOIN k2 ON m.chat_id = k2.chat_id"""
ORACLE["route_calls"] = f"""WITH {PARSED_IOS}
SELECT chat_id, CASE WHEN call_type IS NULL THEN 'message' ELSE 'call' END AS kind, count(*) AS n
FROM typed GROUP BY 1, 2"""
ORACLE["call_types"] = f"""WITH {PARSED_IOS}
SELECT m.chat_id, m.seq, m.sender, {RECEIVER} AS receiver,
 CASE WHEN {_has(COMPLETED)} THEN CAST(regexp_extract(content, '\\d+') AS BIGINT) *
   CASE regexp_extract(content, 'sec|min|h') WHEN 'sec' THEN 1 WHEN 'min' THEN 60 ELSE 3600 END
   ELSE 0 END AS duration,
 call_type AS type,
 CASE WHEN call_type = 'group_call' THEN CAST(regexp_extract(content, '(\\d) invited', 1) AS BIGINT)
   ELSE 0 END AS group_call_invites,
 CASE WHEN call_type LIKE 'silenced%' THEN
   regexp_extract(content, 'silenced (?:voice|video) call, (.+)$', 1) END AS silence_reason,
 m.ts
FROM typed m LEFT JOIN k2 ON m.chat_id = k2.chat_id WHERE call_type IS NOT NULL"""
ORACLE["message_types"] = f"WITH {PARSED_IOS} SELECT chat_id, seq, type, content FROM shown"

ORACLE["strip_links"] = f"""WITH {MESSAGES}
SELECT chat_id, seq, {unlinked("content")} AS content FROM messages WHERE content IS NOT NULL"""
ORACLE["tail_sample"] = f"""WITH {MESSAGES}
SELECT chat_id, seq, sender, receiver, content, ts, type FROM messages
QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) <= 3"""
ORACLE["text_rows"] = f"WITH {MESSAGES} SELECT * FROM messages WHERE type = 'text'"

# -- text ------------------------------------------------------------------------------------------

TOKENS = """
tok AS (SELECT chat_id, seq, content, unnest({words}) AS w, generate_subscripts({words}, 1) AS pos
  FROM {source} WHERE content IS NOT NULL)"""


def tokens_of(source: str) -> str:
    return TOKENS.replace("{words}", words("content")).replace("{source}", source)


def _mapped(source: str, value: str, join: str, extra: str = "") -> str:
    """Token-by-token replacement, rejoined in order."""
    return f"""{tokens_of(source)},
mapped AS (SELECT chat_id, seq, string_agg({value}, ' ' ORDER BY pos) AS mapped
  FROM tok {join} GROUP BY chat_id, seq){extra}"""


EXPANDED = MESSAGES + "," + _mapped(
    "messages",
    "coalesce(d.phrase, w)",
    f"LEFT JOIN (VALUES {rows(ABBREVIATIONS.items())}) d(key, phrase) "
    "ON d.key = regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')",
)
ORACLE["expand_abbreviations"] = f"""WITH {EXPANDED}
SELECT chat_id, seq, CASE WHEN content IS NOT NULL THEN coalesce(mapped, '') END AS content
FROM messages LEFT JOIN mapped USING (chat_id, seq)"""


def dictionary(condition: str = "true") -> str:
    return f"""
dict AS (SELECT word, count(*) AS freq FROM (
    SELECT unnest({words("lower(text)")}) AS word FROM documents WHERE {condition})
  WHERE regexp_matches(word, '^\\p{{L}}+$') GROUP BY word)"""


ORACLE["expand_abbreviations_by_table"] = f"""WITH {MESSAGES}, {dictionary()},
{_mapped("messages", "CASE WHEN d.word IS NULL THEN w ELSE d.word || '*' END",
         "LEFT JOIN dict d ON d.word = regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')")}
SELECT chat_id, seq, CASE WHEN content IS NOT NULL THEN coalesce(mapped, '') END AS content
FROM messages LEFT JOIN mapped USING (chat_id, seq)"""


def named(column: str) -> str:
    return f"replace(replace({column}, '😂', ':face_with_tears_of_joy:'), '👍', ':thumbs_up:')"


ORACLE["demojize"] = f"""WITH {MESSAGES}
SELECT chat_id, seq, {named("content")} AS content FROM messages"""
ORACLE["emojize"] = f"WITH {MESSAGES} SELECT chat_id, seq, content FROM messages"
ORACLE["preprocess"] = f"""WITH {EXPANDED}
SELECT chat_id, seq, {named("CASE WHEN content IS NOT NULL THEN coalesce(mapped, '') END")} AS content
FROM messages LEFT JOIN mapped USING (chat_id, seq)"""

# DuckDB compares bytes, so letters beyond ASCII become single spare characters first.
_ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_SPARE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(_ACCENTED)]


def plain(word: str) -> str:
    return f"translate({word}, '{_ACCENTED}', '{_SPARE}')"


SPELLED = f"""{MESSAGES}, {dictionary("lang = 'en'")},
tagged AS (SELECT *, CASE WHEN chat_id % 4 = 0 THEN 'hi' ELSE 'en' END AS language FROM messages),
fixable AS (SELECT * FROM tagged WHERE language = 'en' AND length({stripped("content")}) > 1),
{tokens_of("fixable")},
unknown AS (SELECT DISTINCT w, {plain("w")} AS pw, length(w) AS n FROM tok
  WHERE regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN (SELECT word FROM dict)),
known AS MATERIALIZED (SELECT word, freq, {plain("word")} AS pk, length(word) AS m FROM dict),
close AS (SELECT w, word, freq, levenshtein(pw, pk) AS d FROM unknown JOIN known
  ON m BETWEEN n - 2 AND n + 2 WHERE levenshtein(pw, pk) <= 2),
fixes AS (SELECT w, first(word ORDER BY d, freq DESC, word) AS word FROM close GROUP BY w),
mapped AS (SELECT chat_id, seq, string_agg(coalesce(f.word, tok.w), ' ' ORDER BY pos) AS mapped
  FROM tok LEFT JOIN fixes f ON f.w = tok.w GROUP BY chat_id, seq),
spelled AS (SELECT t.* REPLACE (coalesce(mapped, content) AS content)
  FROM tagged t LEFT JOIN mapped USING (chat_id, seq))"""
ORACLE["spell_correct"] = f"WITH {SPELLED} SELECT chat_id, seq, language, content FROM spelled"


def unstopped(column: str) -> str:
    kept = f"list_filter({words(column)}, lambda t: NOT list_contains({texts(STOP_WORDS)}, t))"
    return f"CASE WHEN {column} IS NOT NULL THEN coalesce(array_to_string({kept}, ' '), '') END"


ORACLE["remove_stop_words"] = f"""WITH {MESSAGES}
SELECT chat_id, seq, {unstopped("content")} AS content FROM messages"""


def translated(source: str) -> str:
    """Word by word for every language but English; null for blank text."""
    return f"""
tok2 AS (SELECT chat_id, seq, unnest({words("content")}) AS w,
    generate_subscripts({words("content")}, 1) AS pos FROM {source} WHERE language <> 'en'),
turned AS (SELECT chat_id, seq, string_agg(coalesce(d.phrase, w), ' ' ORDER BY pos) AS turned
  FROM tok2 LEFT JOIN (VALUES {rows(WORD_TABLE.items())}) d(key, phrase) ON d.key = w
  GROUP BY chat_id, seq),
translated AS (SELECT t.*, CASE WHEN language = 'en' THEN content ELSE turned END AS translated
  FROM {source} t LEFT JOIN turned USING (chat_id, seq))"""


ORACLE["clean_text"] = f"""WITH {SPELLED}, {translated("spelled")}
SELECT chat_id, seq, language, content, {unstopped("translated")} AS translated
FROM translated WHERE type = 'text'"""
ORACLE["route_translate"] = f"""WITH {MESSAGES},
tagged AS (SELECT *, CASE WHEN chat_id % 4 = 0 THEN 'hi' ELSE 'en' END AS language FROM messages),
{translated("tagged")}
SELECT chat_id, seq, language, content, translated FROM translated"""

ORACLE["translate_phrases"] = f"""WITH RECURSIVE {MESSAGES},
cut AS (SELECT {words("lower(text)")} AS ws, conv_id AS c FROM conversations WHERE turn = 0),
entries AS (SELECT DISTINCT array_to_string(ws[1 + c % 3 : c % 3 + 1 + c % 4], ' ') AS key FROM cut),
tagged AS (SELECT *, CASE WHEN chat_id % 4 = 0 THEN 'hi' ELSE 'en' END AS language FROM messages),
foreign_rows AS (SELECT chat_id, seq, {words("content")} AS ws FROM tagged WHERE language <> 'en' AND content IS NOT NULL),
places AS (SELECT chat_id, seq, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS pos FROM foreign_rows),
best AS (SELECT p.chat_id, p.seq, pos, max(l) AS l FROM places p CROSS JOIN range(1, 5) t(l)
  JOIN entries e ON e.key = array_to_string(ws[pos : pos + l - 1], ' ')
  WHERE pos + l - 1 <= n AND key <> '' GROUP BY ALL),
steps AS MATERIALIZED (SELECT p.chat_id, p.seq, p.pos, coalesce(l, 1) AS l,
  CASE WHEN l IS NULL THEN ws[p.pos] ELSE '<' || array_to_string(ws[p.pos : p.pos + l - 1], '_') || '>' END AS w
  FROM places p LEFT JOIN best b ON p.chat_id = b.chat_id AND p.seq = b.seq AND p.pos = b.pos),
walk AS (SELECT chat_id, seq, pos, l, w FROM steps WHERE pos = 1
  UNION ALL SELECT s.chat_id, s.seq, s.pos, s.l, s.w FROM walk k
  JOIN steps s ON s.chat_id = k.chat_id AND s.seq = k.seq AND s.pos = k.pos + k.l),
turned AS (SELECT chat_id, seq, string_agg(w, ' ' ORDER BY pos) AS turned FROM walk GROUP BY chat_id, seq)
SELECT chat_id, seq, language, CASE WHEN language = 'en' THEN content ELSE turned END AS translated
FROM tagged LEFT JOIN turned USING (chat_id, seq)"""

# -- message statistics ----------------------------------------------------------------------------

ORACLE["top_words"] = f"""WITH {MESSAGES},
w AS (SELECT chat_id, ts, seq, unnest({words("lower(content)")}) AS t,
   generate_subscripts({words("lower(content)")}, 1) AS pos FROM messages WHERE content <> ''),
f AS (SELECT chat_id, ts, seq, pos, regexp_replace(t, '[^A-Za-z0-9]+', '', 'g') AS word FROM w
   WHERE length(t) >= 3 AND NOT regexp_full_match(t, {text(ITEM)})),
c AS (SELECT chat_id, word, count(*) AS n, min(row(ts, seq, pos)) AS seen FROM f GROUP BY 1, 2)
SELECT chat_id, word, n, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, seen) AS rank
FROM c QUALIFY rank <= 10"""


def _emoji(group: str) -> str:
    found = f"regexp_extract_all(content, {text(ITEM)})"
    return f"""WITH {MESSAGES},
e AS (SELECT chat_id, sender, ts, seq, unnest({found}) AS emoji,
   generate_subscripts({found}, 1) AS pos FROM messages WHERE content <> ''),
c AS (SELECT {group}, emoji, count(*) AS n, min(row(ts, seq, pos)) AS seen FROM e GROUP BY ALL)
SELECT {group}, emoji, n, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, seen) AS rank
FROM c QUALIFY rank <= 10"""


ORACLE["top_emojis"] = _emoji("chat_id")
ORACLE["top_emojis_by_sender"] = _emoji("chat_id, sender")

ORACLE["first_texter"] = f"""WITH {MESSAGES},
f AS (SELECT chat_id, CAST(ts AS DATE) AS d, first(sender ORDER BY ts, seq) AS sender
  FROM messages GROUP BY 1, 2)
SELECT chat_id, sender, count(*) AS days FROM f GROUP BY 1, 2"""
ORACLE["avg_message_length"] = f"""WITH {MESSAGES}
SELECT chat_id, sender, round(avg(CASE WHEN content IS NOT NULL THEN len({words("content")}) END), 6)
  AS avg_words FROM messages GROUP BY 1, 2"""
ORACLE["longest_message"] = f"""WITH {MESSAGES},
r AS (SELECT chat_id, sender, content, len({words("content")}) AS length, ts, seq FROM messages
  WHERE content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chat_id, sender ORDER BY length DESC, ts, seq) = 1)
SELECT p.chat_id, p.sender AS participant, r.content, r.length, r.ts
FROM (SELECT DISTINCT chat_id, sender FROM messages) p LEFT JOIN r USING (chat_id, sender)"""
ORACLE["active_hours"] = f"""WITH {MESSAGES}
SELECT chat_id, extract(hour FROM ts) AS hour, count(*) AS n FROM messages GROUP BY 1, 2"""
ORACLE["reply_time"] = f"""WITH {MESSAGES},
g AS (SELECT chat_id, sender, ts, lag(sender) OVER w AS before, lag(ts) OVER w AS before_ts
  FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts, seq)),
s AS (SELECT chat_id, before AS sender, avg(epoch(ts - before_ts)) / 60 AS m FROM g
  WHERE before <> sender AND ts - before_ts <= INTERVAL '480' MINUTE GROUP BY 1, 2)
SELECT p.chat_id, p.sender AS participant, round(m, 6) AS avg_reply_minutes
FROM (SELECT DISTINCT chat_id, sender FROM messages) p LEFT JOIN s USING (chat_id, sender)"""
ORACLE["media_stats"] = f"""WITH {MESSAGES}
SELECT chat_id, sender, type, count(*) AS n FROM messages WHERE type <> 'text' GROUP BY 1, 2, 3"""
ORACLE["media_table"] = f"""WITH {MESSAGES}
SELECT chat_id, sender AS participant, count(*) FILTER (type = 'image') AS image,
 count(*) FILTER (type = 'audio') AS audio,
 count(*) FILTER (type = 'deleted_by_others') AS deleted_by_others FROM messages GROUP BY 1, 2"""


def _phrase(kind: str) -> str:
    phrases = PHRASES[kind]
    hit = f"len(list_filter({texts(phrases)}, lambda p: contains(lower(content), p))) > 0"
    return f"""WITH {MESSAGES}
SELECT chat_id, sender AS participant, count(*) FILTER (content <> '' AND {hit}) AS n
FROM messages GROUP BY 1, 2"""


ORACLE["apologies"] = _phrase("apology")
ORACLE["compliments"] = _phrase("compliment")
ORACLE["questions"] = _phrase("questioning")
ORACLE["swearing"] = _phrase("swearing")

HITS = ", ".join(
    f"count(*) FILTER (content <> '' AND len(list_filter({texts(phrases)}, "
    f"lambda p: contains(lower(content), p))) > 0) AS {kind}"
    for kind, phrases in PHRASES.items()
)
ORACLE["phrase_counts"] = f"""WITH {MESSAGES}
SELECT chat_id, sender AS participant, {HITS} FROM messages GROUP BY 1, 2"""
ORACLE["reply_gaps"] = f"""WITH {MESSAGES},
g AS (SELECT chat_id, sender, ts, lag(sender) OVER w AS before, lag(ts) OVER w AS before_ts
  FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts, seq))
SELECT chat_id, before AS participant, CAST(epoch(ts - before_ts) AS BIGINT) AS seconds,
 count(*) AS n FROM g WHERE before <> sender AND ts - before_ts <= INTERVAL '480' MINUTE
GROUP BY 1, 2, 3"""

SESSIONS = f"""{MESSAGES},
m AS (SELECT * FROM messages WHERE content IS NOT NULL),
o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL '60' MINUTE
  THEN 1 ELSE 0 END AS brk FROM m WINDOW w AS (PARTITION BY chat_id, sender ORDER BY ts, seq)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY chat_id, sender ORDER BY ts, seq
  ROWS UNBOUNDED PRECEDING) AS sid FROM o),
ses AS (SELECT chat_id, sender, sid, min(ts) AS first_ts, min(seq) AS first_seq, max(ts) AS last_ts
  FROM g GROUP BY chat_id, sender, sid),
j AS (SELECT ses.chat_id, ses.sender, ses.sid, ses.first_seq, ses.last_ts, m.ts, m.seq, m.content,
  CASE WHEN m.sender = ses.sender AND m.seq <> ses.first_seq THEN 2 ELSE 1 END AS reps
  FROM ses JOIN m ON m.chat_id = ses.chat_id
  AND (m.ts > ses.first_ts OR (m.ts = ses.first_ts AND m.seq >= ses.first_seq))
  AND m.ts <= ses.last_ts + INTERVAL '60' MINUTE)"""
ORACLE["context_members"] = f"""WITH {SESSIONS}
SELECT chat_id, sender, first_seq, last_ts, seq, CAST(reps AS BIGINT) AS copies FROM j"""
ORACLE["contexts"] = f"""WITH {SESSIONS},
c AS (SELECT ses.chat_id, ses.sender, ses.sid, m.receiver,
  row_number() OVER (PARTITION BY ses.chat_id, ses.sender, ses.sid ORDER BY m.ts, m.seq) AS rn
  FROM ses JOIN m ON m.chat_id = ses.chat_id AND m.ts > ses.last_ts + INTERVAL '60' MINUTE),
lastrow AS (SELECT chat_id, receiver AS last_receiver FROM m
  QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, seq DESC) = 1),
txt AS (SELECT chat_id, sender, sid, last_ts, max(ts) AS end_ts,
  string_agg(content, ' ' ORDER BY ts, seq) AS merged_content
  FROM j CROSS JOIN (VALUES (1),(2)) AS r(k) WHERE r.k <= j.reps
  GROUP BY chat_id, sender, sid, last_ts)
SELECT txt.chat_id, txt.sender, CASE WHEN c.rn IS NULL THEN l.last_receiver ELSE c.receiver END
 AS receiver, txt.merged_content, CAST(txt.last_ts AS DATE) AS date, txt.last_ts AS start_ts,
 CASE WHEN c.rn IS NULL THEN txt.end_ts ELSE txt.last_ts END AS end_ts
FROM txt LEFT JOIN c ON c.chat_id = txt.chat_id AND c.sender = txt.sender AND c.sid = txt.sid
  AND c.rn = 1 JOIN lastrow l ON l.chat_id = txt.chat_id
WHERE length(trim(txt.merged_content)) > 3"""

KINDS = """(VALUES
 ('tone', 'Analyze the tone of this text: ', 50),
 ('topics', 'Extract key topics from this text: ', 100),
 ('relationships', 'Analyze the relationships between <people> based on this text: ', 150),
 ('language_used', 'Detect the language(s) used in this text and return their ISO 639-1 codes: ', 50),
 ('humor_level', 'Analyze the humor level in this text (low, medium, high): ', 50),
 ('cultural_backgrounds', 'Infer the cultural backgrounds of <people> based on this text: ', 150),
 ('llm_insights', 'Generate unique insights about this conversation: ', 200))
 AS k(kind, head, max_length)"""
PROMPTS = f"""WITH {MESSAGES},
x AS (SELECT chat_id, string_agg(content, ' ' ORDER BY seq) AS body FROM messages
  WHERE content IS NOT NULL GROUP BY chat_id),
p AS (SELECT chat_id, string_agg(DISTINCT sender, ', ' ORDER BY sender) AS people FROM messages
  GROUP BY chat_id)"""
ORACLE["llm_prompts"] = f"""{PROMPTS}
SELECT x.chat_id, k.kind, 0::BIGINT AS part,
 replace(k.head, '<people>', p.people) || x.body AS prompt, k.max_length::BIGINT AS max_length
FROM x JOIN p USING (chat_id) CROSS JOIN {KINDS}"""
ORACLE["prompt_texts"] = f"""{PROMPTS} SELECT chat_id, 0::BIGINT AS part, body AS text FROM x"""
ORACLE["prompt_heads"] = f"""{PROMPTS}
SELECT p.chat_id, k.kind, replace(k.head, '<people>', p.people) AS head,
 k.max_length::BIGINT AS max_length FROM p CROSS JOIN {KINDS}"""

# -- calls -----------------------------------------------------------------------------------------

ORACLE["avg_call_duration"] = f"""WITH {CALLS}
SELECT chat_id, round(coalesce(avg(duration) FILTER (duration > 0), 0), 6) AS avg_duration
FROM calls GROUP BY 1"""
ORACLE["call_mode"] = f"""WITH {CALLS}
SELECT chat_id, type, count(*) AS n FROM calls GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, type) = 1"""
ORACLE["calls_per_day"] = f"""WITH {CALLS}
SELECT chat_id, round(avg(n), 6) AS avg_calls FROM
 (SELECT chat_id, CAST(ts AS DATE) AS d, count(*) AS n FROM calls GROUP BY 1, 2) q GROUP BY 1"""
ORACLE["call_hours"] = f"""WITH {CALLS}
SELECT chat_id, extract(hour FROM ts) AS hour, count(*) AS n FROM calls GROUP BY 1, 2"""
ORACLE["longest_call"] = f"""WITH {CALLS}
SELECT chat_id, seq, sender, receiver, duration, type, ts FROM calls
QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY duration DESC, seq) = 1"""
ORACLE["calls_per_sender"] = f"""WITH {CALLS}
SELECT chat_id, sender, count(*) AS n FROM calls GROUP BY 1, 2"""
ORACLE["calls_per_type"] = f"""WITH {CALLS}
SELECT chat_id, type, count(*) AS n FROM calls GROUP BY 1, 2"""
ORACLE["missed_calls"] = f"""WITH {CALLS}
SELECT chat_id, receiver, count(*) AS n FROM calls WHERE type IN ('missed_voice_call',
 'missed_video_call', 'silenced_voice_call', 'silenced_video_call') GROUP BY 1, 2"""
ORACLE["days_without_calls"] = f"""WITH {CALLS},
d AS (SELECT DISTINCT chat_id, CAST(ts AS DATE) AS date FROM calls),
s AS (SELECT chat_id, min(date) AS a, max(date) AS b FROM d GROUP BY 1),
x AS (SELECT chat_id, CAST(unnest(generate_series(a, b, INTERVAL '1' DAY)) AS DATE) AS date FROM s)
SELECT chat_id, date FROM x EXCEPT SELECT chat_id, date FROM d"""
ORACLE["busiest_call_days"] = f"""WITH {CALLS},
c AS (SELECT chat_id, CAST(ts AS DATE) AS date, sender, count(*) AS n FROM calls GROUP BY 1, 2, 3),
d AS (SELECT chat_id, date, CAST(sum(n) AS BIGINT) AS day_calls FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY day_calls DESC, date) AS rank
  FROM d QUALIFY rank <= 3)
SELECT c.chat_id, c.date, c.sender, c.n, r.day_calls, r.rank,
 strftime(c.date, '%B %d, %Y') AS day FROM c JOIN r USING (chat_id, date)"""

# -- scored contexts -------------------------------------------------------------------------------


def _feeling(names: str, score: str, percentage: str) -> str:
    return f"""WITH {SCORED},
h AS (SELECT chat_id, sender, count(*) FILTER (score > 0.001 AND emotion IN ({names})) AS hits
  FROM emotions_long GROUP BY 1, 2),
n AS (SELECT chat_id, sender, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT chat_id, sender AS participant, hits AS {score},
 round_even(hits / n * 100, 2) AS {percentage} FROM h JOIN n USING (chat_id, sender)"""


ORACLE["love_score"] = _feeling("'love', 'caring'", "love_score", "love_percentage")
ORACLE["hate_score"] = _feeling("'anger', 'annoyance'", "hate_score", "hate_percentage")
ORACLE["sentiment_summary"] = f"""WITH {SCORED},
a AS (SELECT chat_id, sender, avg(mood) AS m FROM scored GROUP BY 1, 2)
SELECT chat_id, sender, sentiment, count(*) AS n, round(any_value(m), 6) AS mean_sentiment
FROM scored JOIN a USING (chat_id, sender) GROUP BY 1, 2, 3"""
ORACLE["mood_trends"] = f"""WITH {SCORED},
d AS (SELECT chat_id, date, avg(mood) AS s, avg(tox_score) AS t FROM scored GROUP BY 1, 2)
SELECT chat_id, date, round(avg(s) OVER w, 6) AS sentiment_rolling,
 round(avg(t) OVER w, 6) AS toxicity_rolling
FROM d WINDOW w AS (PARTITION BY chat_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
ORACLE["emotion_trend"] = f"""WITH {SCORED},
e AS (SELECT chat_id, CAST(date_trunc('week', date) AS DATE) AS week, emotion, score
  FROM emotions_long),
weeks AS (SELECT DISTINCT chat_id, week FROM e),
tot AS (SELECT chat_id, week, sum(score) AS total FROM e WHERE emotion <> 'neutral' GROUP BY 1, 2),
s AS (SELECT chat_id, week, emotion, sum(score) AS x FROM e GROUP BY 1, 2, 3)
SELECT w.chat_id, w.week, l.emotion,
 round(CASE WHEN tot.total > 0 THEN coalesce(s.x, 0) / tot.total END, 6) AS share
FROM weeks w CROSS JOIN (SELECT unnest({texts([x for x in EMOTIONS if x != "neutral"])}) AS emotion) l
LEFT JOIN tot ON tot.chat_id = w.chat_id AND tot.week = w.week
LEFT JOIN s ON s.chat_id = w.chat_id AND s.week = w.week AND s.emotion = l.emotion"""


_SHARES = ", ".join(
    f"round(CASE WHEN max(tot.total) > 0 THEN coalesce(sum(e.score) FILTER (e.emotion = '{x}'), 0)"
    f" / max(tot.total) END, 6) AS {x}"
    for x in EMOTIONS
    if x != "neutral"
)
ORACLE["emotion_trend_wide"] = f"""WITH {SCORED},
e AS (SELECT chat_id, CAST(date_trunc('week', date) AS DATE) AS week, emotion, score
  FROM emotions_long),
tot AS (SELECT chat_id, week, sum(score) AS total FROM e WHERE emotion <> 'neutral' GROUP BY 1, 2)
SELECT e.chat_id, e.week, {_SHARES} FROM e LEFT JOIN tot ON tot.chat_id = e.chat_id
 AND tot.week = e.week GROUP BY 1, 2"""


def _cut(x: str, lo: str, hi: str, labels: list[str]) -> str:
    step = f"(({hi} - {lo}) / 5)"
    return f"""CASE WHEN {lo} = {hi} THEN '{labels[2]}'
 WHEN {x} > {lo} - ({hi} - {lo}) * 0.001 AND {x} <= 1 * {step} + {lo} THEN '{labels[0]}'
 WHEN {x} > 1 * {step} + {lo} AND {x} <= 2 * {step} + {lo} THEN '{labels[1]}'
 WHEN {x} > 2 * {step} + {lo} AND {x} <= 3 * {step} + {lo} THEN '{labels[2]}'
 WHEN {x} > 3 * {step} + {lo} AND {x} <= 4 * {step} + {lo} THEN '{labels[3]}'
 WHEN {x} > 4 * {step} + {lo} AND {x} <= {hi} THEN '{labels[4]}' END"""


ORACLE["mood_heatmap"] = f"""WITH {SCORED},
w AS (SELECT chat_id, strftime(date, '%Y-%U') AS week, avg(mood) AS s, avg(tox_score) AS t
  FROM scored GROUP BY 1, 2),
l AS (SELECT *, min(s) OVER c AS s0, max(s) OVER c AS s1, min(t) OVER c AS t0, max(t) OVER c AS t1
  FROM w WINDOW c AS (PARTITION BY chat_id))
SELECT chat_id, week,
 {_cut("s", "s0", "s1", ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"])}
 AS sentiment_bin,
 {_cut("t", "t0", "t1", ["Very Low", "Low", "Moderate", "High", "Very High"])} AS toxicity_bin
FROM l"""
ORACLE["toxicity_summary"] = f"""WITH {SCORED}
SELECT chat_id,
 row_number() OVER (PARTITION BY chat_id ORDER BY tox_score DESC, ts, date, src, seq, sender) AS rank,
 src, seq, sender, merged_content, round(tox_score, 6) AS toxicity_score, tox_type AS toxicity_type
FROM scored WHERE tox_score > 0.5 QUALIFY rank <= 10"""
ORACLE["emotions_str"] = f"""WITH {SCORED}
SELECT src, seq, string_agg(emotion, ', ' ORDER BY i) AS emotions
FROM emotions_long WHERE score > 0.001 GROUP BY 1, 2"""

# -- model outputs ---------------------------------------------------------------------------------



def vectors(n: int) -> str:
    """n logits that together use all 64 values: value j counts for logit j mod n."""
    sums = ", ".join(" + ".join(f"x[{j + 1}]" for j in range(i, 64, n)) for i in range(n))
    return f"""v AS (SELECT vec_id, [{sums}] AS x
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"""




def _softmax(x: str) -> str:
    exps = f"list_transform({x}, lambda z: exp(z - list_max({x})))"
    return f"list_transform({exps}, lambda z: z / list_sum({exps}))"


ORACLE["sentiment_label"] = f"""WITH {vectors(5)}
SELECT vec_id, list_extract(['Very Negative', 'Negative', 'Neutral', 'Positive', 'Very Positive'],
 list_position(x[1:5], list_max(x[1:5]))) AS sentiment FROM v"""
ORACLE["top_emotions"] = f"""WITH {vectors(28)},
p AS (SELECT vec_id, {_softmax("x[1:28]")} AS p FROM v),
u AS (SELECT vec_id, generate_subscripts(p, 1) AS i, round(unnest(p), 4) AS score FROM p)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) - 1 AS rank,
 list_extract({texts(EMOTIONS)}, i) AS emotion, score FROM u QUALIFY rank < 3"""


def _toxic(x: str) -> str:
    """Rounded sigmoid per label."""
    return f"list_transform({x}, lambda z: round(1 / (1 + exp(-z)), 4))"


ORACLE["toxicity_post"] = f"""WITH {vectors(7)}, p AS (SELECT vec_id, {_toxic("x[1:7]")} AS p FROM v)
SELECT vec_id, p[1] AS score, CASE WHEN p[1] > 0.5 THEN
 list_extract({texts(TOXICITY_LABELS[1:])}, list_position(p[2:7], list_max(p[2:7]))) END AS type
FROM p"""
_EN, _HI = LANGUAGES.index("en") + 1, LANGUAGES.index("hi") + 1
ORACLE["restrict_language"] = f"""WITH {vectors(20)}
SELECT vec_id, CASE WHEN x[{_HI}] > x[{_EN}] THEN 'hi' ELSE 'en' END AS language FROM v"""


def _grams(source: str, keys: str, column: str) -> str:
    """One row per character trigram of the padded lower-cased words."""
    return f"""(SELECT {keys}, substr(p, i, 3) AS gram FROM (
  SELECT {keys}, ' ' || w || ' ' AS p, unnest(range(1, length(w) + 1)) AS i FROM (
    SELECT {keys}, unnest({words(f"lower({column})")}) AS w FROM {source})))"""


ORACLE["detect_language"] = f"""WITH {MESSAGES},
g AS (SELECT lang, gram, count(*) AS n FROM {_grams("documents", "lang", "text")}
  WHERE lang IS NOT NULL GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS t, (SELECT count(DISTINCT gram) FROM g) AS v FROM g GROUP BY lang),
m AS (SELECT chat_id, seq, gram, count(*) AS c FROM {_grams("messages", "chat_id, seq", "content")} GROUP BY ALL),
sizes AS (SELECT chat_id, seq, sum(c) AS size FROM m GROUP BY ALL),
hits AS (SELECT chat_id, seq, lang, sum(c * ln(n + 1)) AS s FROM m JOIN g USING (gram) GROUP BY ALL),
scores AS (SELECT chat_id, seq, lang, coalesce(s, 0) - size * ln(t + v) AS score
  FROM sizes CROSS JOIN tot LEFT JOIN hits USING (chat_id, seq, lang)),
best AS (SELECT chat_id, seq, lang FROM scores
  QUALIFY row_number() OVER (PARTITION BY chat_id, seq ORDER BY score DESC, lang) = 1)
SELECT chat_id, seq, lang AS language FROM messages LEFT JOIN best USING (chat_id, seq)"""

ORACLE["toxicity_model"] = f"""WITH
w AS (SELECT DISTINCT doc_id, unnest({words("lower(text)")}) AS w FROM documents),
prior AS (SELECT avg(toxic::DOUBLE) AS p FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
n AS (SELECT w, count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1
  FROM w JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY w),
s AS (SELECT doc_id, sum(ln((n1 + 10 * p) / (n0 + 10 * (1 - p))) - ln(p / (1 - p))) AS s
  FROM w JOIN n USING (w) CROSS JOIN prior GROUP BY doc_id)
SELECT doc_id, CASE WHEN {stripped("text")} <> '' THEN
  round(1 / (1 + exp(-(coalesce(s, 0) + ln(p / (1 - p))))), 4) END AS toxicity_score
FROM documents LEFT JOIN s USING (doc_id) CROSS JOIN prior"""


ORACLE["read_dictionary"] = "SELECT lower(p_name || ' ' || p_partkey) AS key, lower(p_type) AS phrase FROM part"
ORACLE["read_results"] = f"""SELECT CAST(chat_id AS VARCHAR) AS chat_id, CAST(date AS VARCHAR) AS date, sender,
 CAST(n AS VARCHAR) AS n, day FROM ({ORACLE["busiest_call_days"]})"""


def _report() -> str:
    """The report in long form, put together from the SQL of its statistics.

    Message statistics are those of the preprocessed text, in which an emoji's name counts as the emoji.
    """
    said = MESSAGES.replace("messages AS (", "raw AS (") + """,
messages AS (SELECT raw.* REPLACE (pre.content AS content) FROM raw JOIN pre USING (chat_id, seq))"""
    people = f"SELECT DISTINCT chat_id, sender FROM (WITH {MESSAGES} SELECT * FROM messages)"
    scored = f"SELECT DISTINCT chat_id, sender FROM (WITH {SCORED} SELECT * FROM scored)"
    absent = lambda sql, columns: f"SELECT p.chat_id, p.sender, {columns} FROM ({people}) p LEFT JOIN ({sql}) s USING (chat_id, sender)"
    on = lambda name: ORACLE[name].replace(MESSAGES, said)
    for_people = lambda sql, columns: f"SELECT p.chat_id, p.sender AS participant, {columns} FROM ({people}) p LEFT JOIN ({sql}) s ON s.chat_id = p.chat_id AND s.participant = p.sender"
    toxic = f"""SELECT t.chat_id, t.rank, t.sender, s.receiver, t.merged_content, s.date, s.sentiment, t.toxicity_score,
 t.toxicity_type, e.emotions AS emotions_str FROM ({ORACLE["toxicity_summary"]}) t
 JOIN (WITH {SCORED} SELECT * FROM scored) s USING (src, seq) JOIN ({ORACLE["emotions_str"]}) e USING (src, seq)"""
    moods = [e for e in EMOTIONS if e != "neutral"]
    # section -> (SQL, what names an item, texts, numbers)
    sections = {
        "most_used_words_phrases": (on("top_words"), ["rank"], ["word"], ["n"]),
        "who_texts_first_most": (on("first_texter"), ["sender"], [], ["days"]),
        "who_sends_longer_messages": (on("avg_message_length"), ["sender"], [], ["avg_words"]),
        "longest_message": (on("longest_message"), ["participant"], ["content", "ts"], ["length"]),
        "average_reply_time": (on("reply_time"), ["participant"], [], ["avg_reply_minutes"]),
        "media_stats": (absent(on("media_stats"), "type, coalesce(n, 0) AS n"), ["sender", "type"], [], ["n"]),
        "most_active_chat_times": (on("active_hours"), ["hour"], [], ["n"]),
        "most_used_emojis": (ORACLE["top_emojis"], ["rank"], ["emoji"], ["n"]),
        "most_used_emojis_by_sender": (
            absent(ORACLE["top_emojis_by_sender"], "emoji, rank, coalesce(n, 0) AS n"), ["sender", "rank"], ["emoji"], ["n"]
        ),
        "insights": (on("phrase_counts"), ["participant"], [], ["apology", "compliment", "questioning", "swearing"]),
        "missed_calls_per_participant": (ORACLE["missed_calls"], ["receiver"], [], ["n"]),
        "most_active_call_times": (ORACLE["call_hours"], ["hour"], [], ["n"]),
        "longest_call_details": (ORACLE["longest_call"], [], ["sender", "receiver", "type", "ts"], ["seq", "duration"]),
        "total_calls_per_participant": (ORACLE["calls_per_sender"], ["sender"], [], ["n"]),
        "type_of_calls_count": (ORACLE["calls_per_type"], ["type"], [], ["n"]),
        "toxicity_summary": (
            toxic, ["rank"], ["sender", "receiver", "merged_content", "date", "sentiment", "toxicity_type", "emotions_str"],
            ["toxicity_score"],
        ),
        "sentiment_summary": (ORACLE["sentiment_summary"], ["sender", "sentiment"], [], ["n", "mean_sentiment"]),
        "mood_trends": (ORACLE["mood_trends"], ["date"], [], ["sentiment_rolling", "toxicity_rolling"]),
        "emotion_trend": (ORACLE["emotion_trend_wide"], ["week"], [], moods),
        "mood_toxicity_heatmap": (ORACLE["mood_heatmap"], ["week"], ["sentiment_bin", "toxicity_bin"], []),
        "love_score": (for_people(ORACLE["love_score"], "coalesce(love_score, 0) AS love_score, coalesce(love_percentage, 0) AS love_percentage"), ["participant"], [], ["love_score", "love_percentage"]),
        "hate_score": (for_people(ORACLE["hate_score"], "coalesce(hate_score, 0) AS hate_score, coalesce(hate_percentage, 0) AS hate_percentage"), ["participant"], [], ["hate_score", "hate_percentage"]),
    }
    out = [f"SELECT chat_id, 'participants' AS field, sender AS item, sender AS text, NULL::DOUBLE AS value FROM ({people})"]
    for section, (sql, names, texts_, numbers) in sections.items():
        item = f"concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in names)})" if names else "''"
        for column in [*texts_, *numbers]:
            said_, counted = (f"CAST({column} AS VARCHAR)", "NULL") if column in texts_ else ("NULL", f"CAST({column} AS DOUBLE)")
            out.append(f"SELECT chat_id, '{section}.{column}', {item}, {said_}, {counted} FROM ({sql})")
    for field, (name, column) in {
        "average_call_duration": ("avg_call_duration", "avg_duration"), "average_call_frequency_per_day": ("calls_per_day", "avg_calls"),
    }.items():
        out.append(f"SELECT chat_id, '{field}', '', NULL, CAST({column} AS DOUBLE) FROM ({ORACLE[name]})")
    out.append(f"SELECT chat_id, 'most_frequent_call_type', '', type, NULL FROM ({ORACLE['call_mode']})")
    return f"WITH pre AS MATERIALIZED ({ORACLE['preprocess']})\n" + "\nUNION ALL\n".join(out)


ORACLE["full_report"] = _report()
