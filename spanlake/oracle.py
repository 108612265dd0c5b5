"""DuckDB SQL for the queries, built from the same tables of rules.

Patterns go to DuckDB as they are: its classes are ASCII, which is the same on
the tables queried here.
"""

from __future__ import annotations

import re

from spanlake import rules
from spanlake.plans import fixtures, planted


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def scan(table: str, key: str, pattern: str, extra: str = "NULL") -> str:
    """key, start (bytes), cs (code points), m of each match."""
    return f"""SELECT {key}, {extra} AS ord, CAST(strlen(replace(array_to_string(p[:i - 1], ''), chr(2), '')) AS INT) AS start,
       length(replace(array_to_string(p[:i - 1], ''), chr(2), '')) AS cs, split_part(p[i], chr(2), 1) AS m
FROM (SELECT {key}, p, unnest(generate_series(2, len(p))) AS i FROM (
  SELECT {key}, string_split(regexp_replace(translate(text, chr(1) || chr(2), '  '), {q(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p
  FROM {table} WHERE regexp_matches(text, {q(pattern)})))"""


LUHN = """(length(d) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform(generate_series(1, length(d)), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(substr(d, length(d) + 1 - i, 1) AS INT)
       ELSE (2 * CAST(substr(d, length(d) + 1 - i, 1) AS INT)) % 10 + (2 * CAST(substr(d, length(d) + 1 - i, 1) AS INT)) // 10 END)), 1) % 10 = 0)"""


def luhn(text: str) -> str:
    return LUHN.replace("(d)", f"(regexp_replace({text}, '[^0-9]', '', 'g'))").replace("(d,", f"(regexp_replace({text}, '[^0-9]', '', 'g'),")


def iban(text: str) -> str:
    clean = f"regexp_replace({text}, '\\s', '', 'g')"
    moved = f"(substr({clean}, 5) || substr({clean}, 1, 4))"
    return (
        f"CASE WHEN regexp_full_match({clean}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}') THEN list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
        "lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END) = 1 ELSE false END"
    )


def ssn(text: str) -> str:
    n = [f"try_cast(split_part({text}, '-', {i}) AS INT)" for i in (1, 2, 3)]
    return f"coalesce(len(string_split({text}, '-')) = 3 AND regexp_full_match({text}, '[+]?[0-9]+-[+]?[0-9]+-[+]?[0-9]+') AND {n[0]} NOT IN (0, 666) AND {n[0]} < 900 AND {n[1]} <> 0 AND {n[2]} <> 0, false)"


def valid(kind: str, text: str) -> str:
    return f"CASE {kind} WHEN 'CREDIT_CARD' THEN {luhn(text)} WHEN 'IBAN' THEN {iban(text)} WHEN 'SSN' THEN {ssn(text)} ELSE true END"


TYPE = "CASE ord " + " ".join(f"WHEN {i} THEN {q(t)}" for i, (t, _, _) in enumerate(rules.RECOGNIZERS)) + " END"
SCORE = "CASE ord " + " ".join(f"WHEN {i} THEN CAST({s} AS DOUBLE)" for i, (_, _, s) in enumerate(rules.RECOGNIZERS)) + " END"


def candidates(table: str = "documents", key: str = "doc_id") -> str:
    """WITH items: cand (key, start, cs, ord, m, entity_type, score)."""
    every = "\nUNION ALL\n".join(scan(table, key, p, str(i)) for i, (_, p, _) in enumerate(rules.RECOGNIZERS))
    return f"cand AS (SELECT *, {TYPE} AS entity_type, {SCORE} AS score FROM ({every}) WHERE NOT (ord = 1 AND regexp_extract(m, {q(rules.DATE)}) = m))"


def keywords() -> str:
    return "CASE entity_type " + " ".join(f"WHEN {q(t)} THEN {listed(k)}" for t, k in rules.KEYWORDS.items()) + " ELSE [] END"


W = r"[\p{L}\p{N}''\-]"
#: good: valid candidates; near: with their context; boosted: with raised scores.
BOOSTED = f"""good AS (SELECT * FROM cand WHERE {valid("entity_type", "m")}),
near AS (SELECT g.*, regexp_replace(substr(d.text, 1, cs), CASE WHEN regexp_matches(m, '^{W}') THEN '{W}+$' ELSE '^$' END, '') AS before,
                regexp_replace(substr(d.text, cs + length(m) + 1), CASE WHEN regexp_matches(m, '{W}$') THEN '^{W}+' ELSE '^$' END, '') AS after
         FROM good g JOIN documents d USING (doc_id)),
boosted AS (SELECT doc_id, start, start + CAST(strlen(m) AS INT) AS "end", entity_type, m AS text, ord,
   CASE WHEN list_has_any(list_concat(list_reverse(regexp_extract_all(lower(before), '{W}+'))[1:6], regexp_extract_all(lower(after), '{W}+')[1:6]), {keywords()})
        THEN least(1.0, score + CAST(0.15 AS DOUBLE)) ELSE score END AS score FROM near)"""
PREC = "CASE WHEN {0}.entity_type IN (" + ", ".join(q(t) for t in rules.STRUCTURED) + ") THEN 2 ELSE 1 END"
#: kept: the merged spans, one row each.
MERGED = f"""lists AS (SELECT doc_id, list({{'start': start, 'end': "end", 'entity_type': entity_type, 'score': score, 'text': text}} ORDER BY start, score DESC, ord) AS l FROM boosted GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(list_transform(l, lambda z: [z]), lambda acc, b:
   CASE WHEN NOT (acc[-1].start < b[1]."end" AND b[1].start < acc[-1]."end") THEN list_concat(acc, b)
        WHEN {PREC.format("b[1]")} > {PREC.format("acc[-1]")} OR ({PREC.format("b[1]")} = {PREC.format("acc[-1]")} AND b[1].score > acc[-1].score) THEN list_concat(acc[:-2], b)
        ELSE acc END) AS l FROM lists),
kept AS (SELECT doc_id, s.start AS start, s."end" AS "end", s.entity_type AS entity_type, s.score AS score, s.text AS text FROM (SELECT doc_id, unnest(l) AS s FROM folded))"""
ALL = f"{candidates()},\n{BOOSTED},\n{MERGED},\nspans AS (SELECT * FROM kept WHERE score >= 0.5)"


def with_spans(select: str) -> str:
    return f"WITH {ALL}\n{select}"


def threshold_case(slider: float, by_group: dict | None = None) -> str:
    def one(t: str) -> float:
        s = (by_group or {}).get(rules.GROUP_OF.get(t), slider)
        base, delta = rules.SENSITIVITY[t]
        high, low = min(1.0, max(0.0, base + delta)), min(1.0, max(0.0, base - delta))
        return high - s * (high - low)

    return "CASE entity_type " + " ".join(f"WHEN {q(t)} THEN CAST({one(t)!r} AS DOUBLE)" for t in rules.ENTITY_TYPES) + " END"


# ---- links

SCHEME = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, 1, instr({u}, '://') - 1) ELSE '' END"


def url_table(source: str) -> str:
    """parts of u: scheme, userinfo, host, path, query, fragment; source has k, u."""
    return f"""a AS (SELECT k, u, CASE WHEN instr(u, '://') > 0 THEN substr(u, 1, instr(u, '://') - 1) ELSE '' END AS scheme, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE u END AS r0 FROM {source}),
b AS (SELECT *, CASE WHEN instr(r0, '#') > 0 THEN substr(r0, instr(r0, '#') + 1) ELSE '' END AS fragment, split_part(r0, '#', 1) AS r1 FROM a),
c AS (SELECT *, CASE WHEN instr(r1, '?') > 0 THEN substr(r1, instr(r1, '?') + 1) ELSE '' END AS query, split_part(r1, '?', 1) AS r2 FROM b),
e AS (SELECT *, split_part(r2, '/', 1) AS authority, CASE WHEN instr(r2, '/') > 0 THEN substr(r2, instr(r2, '/')) ELSE '' END AS path FROM c),
parts AS (SELECT k, u, scheme, path, query, fragment, instr(authority, '@') > 0 AS has_user, split_part(string_split(authority, '@')[-1], ':', 1) AS host FROM e)"""


def token(t: str) -> str:
    n = lambda p: f"(length({t}) - length(regexp_replace({t}, '{p}', '', 'g')))"
    return f"((length({t}) >= 32 AND regexp_full_match({t}, '[0-9A-Fa-f]+')) OR ({n('[0-9]')} = length({t}) AND length({t}) >= 9) OR (length({t}) >= 20 AND {n('[0-9]')} > 0 AND {n('[A-Z]')} > 0 AND {n('[a-z]')} > 0) OR (length({t}) >= 24 AND {n('[0-9]')} >= 4 AND instr({t}, '-') = 0))"


def identifier(s: str) -> str:
    return f"(regexp_matches(replace({s}, '%40', '@'), {q(rules.EMAIL_LIKE)}) OR regexp_matches({s}, {q(rules.UUID)}) OR len(list_filter(regexp_extract_all({s}, {q(rules.TOKEN_RUN)}), lambda t: {token('t')})) > 0)"


def under(host: str, domains) -> str:
    return f"list_has_any(list_transform(generate_series(1, len(string_split({host}, '.'))), lambda i: array_to_string(string_split({host}, '.')[i:], '.')), {listed(domains)})"


def sensitive_query(s: str) -> str:
    key = "lower(CASE WHEN instr(p, '=') > 0 THEN split_part(p, '=', 1) ELSE '' END)"
    value = "(CASE WHEN instr(p, '=') > 0 THEN substr(p, instr(p, '=') + 1) ELSE p END)"
    return f"len(list_filter(regexp_split_to_array({s}, '[&;]'), lambda p: {value} <> '' AND (list_contains({listed(rules.SENSITIVE_KEYS)}, {key}) OR regexp_matches({key}, {q('|'.join(rules.SENSITIVE_KEY_PARTS))}) OR {identifier(value)}))) > 0"


def private_path(p: str) -> str:
    seg = f"list_filter(regexp_split_to_array({p}, '[/\\\\]'), lambda s: s <> '' AND NOT ends_with(s, ':'))"
    at = lambda i: f"lower(({seg})[{i}])"
    account = f"CASE WHEN {at(1)} IN ('home', 'users', 'media') THEN {at(2)} WHEN {at(1)} = 'run' AND {at(2)} = 'media' THEN {at(3)} WHEN {at(1)} = 'mnt' AND {at(3)} = 'users' THEN {at(4)} END"
    return f"(starts_with({p}, '\\\\') OR coalesce(NOT list_contains({listed(rules.SHARED_HOMES)}, {account}), false) OR len(list_filter({seg}, lambda s: {identifier('s')})) > 0)"


def private_flag(listed_domains=()) -> str:
    seg = "list_filter(string_split(path, '/'), lambda s: s <> '')"
    h = "lower(host)"
    profile = f"CASE WHEN {under(h, ['linkedin.com'])} THEN coalesce(list_contains(['in', 'pub', 'company', 'school', 'showcase'], ({seg})[1]) AND len({seg}) > 1, false) ELSE {under(h, rules.PROFILE_DOMAINS)} AND len({seg}) > 0 AND NOT list_contains({listed(rules.SITE_PAGES)}, lower(({seg})[1])) END"
    local = f"({h} = 'localhost' OR ends_with({h}, '.localhost'))"
    return f"""CASE WHEN lower(scheme) = 'file' THEN {private_path("ltrim(path, '/')")} OR {private_path('path')}
 WHEN has_user THEN true WHEN host = '' THEN false
 ELSE regexp_matches({h}, {q(rules.IPV4)}) OR (NOT {local} AND (instr({h}, '.') = 0 OR list_contains({listed(rules.PRIVATE_SUFFIXES)}, string_split({h}, '.')[-1])))
   OR ({under(h, rules.TENANT_DOMAINS)} AND NOT list_contains({listed(rules.TENANT_DOMAINS)}, {h}) AND NOT starts_with({h}, 'www.'))
   OR (len({seg}) > 0 AND {under(h, rules.DOCUMENT_DOMAINS)}) OR ({profile})
   OR len(list_filter({seg}, lambda s: starts_with(s, '@') OR {identifier('s')})) > 0
   OR {sensitive_query('query')} OR {sensitive_query('fragment')} OR NOT {under(h, [*rules.PUBLIC_DOMAINS, *listed_domains])} END"""


ORACLES: dict[str, str] = {}

for name, kind in {"scan_email": "EMAIL", "scan_phone": "PHONE", "scan_ssn": "SSN", "scan_card": "CREDIT_CARD", "scan_ip": "IP_ADDRESS", "scan_iban": "IBAN", "scan_date": "DATE"}.items():
    ORACLES[name] = f"""WITH {candidates()} SELECT doc_id, start, start + CAST(strlen(m) AS INT) AS "end", m AS text, score FROM cand WHERE entity_type = '{kind}'"""

FIXTURE = fixtures.texts_sql()
ORACLES["scan_fixture"] = f"""WITH fx AS (SELECT id, CASE case_id WHEN 7 THEN replace(replace(text, 'é', 'zz'), 'ü', 'zz') ELSE text END AS text FROM {FIXTURE}), {candidates("fx", "id")} SELECT CAST(id AS BIGINT) AS id, start, start + CAST(strlen(m) AS INT) AS "end", entity_type, m AS text, score FROM cand"""
ORACLES["luhn_valid_cards"] = f"WITH {candidates()} SELECT doc_id, start, m AS text FROM cand WHERE entity_type = 'CREDIT_CARD' AND {luhn('m')}"
ORACLES["checksums"] = f"SELECT id, entity_type, {valid('entity_type', 'text')} AS valid FROM {fixtures.each_sql(fixtures.NUMBERS, 'text, entity_type')}"
ORACLES["context_boosted_spans"] = f'WITH {candidates()}, {BOOSTED} SELECT doc_id, start, "end", entity_type, text, score FROM boosted'
ORACLES["merged_spans"] = f'WITH {candidates()}, {BOOSTED}, {MERGED} SELECT doc_id, start, "end", entity_type, score FROM kept'
ORACLES["detect_all"] = with_spans("""SELECT doc_id, start, "end", entity_type, score, text, 'regex' AS source FROM spans""")
ORACLES["spans_by_type"] = with_spans("SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM spans GROUP BY 1")
ORACLES["spans_by_lang"] = with_spans("SELECT d.lang, count(s.doc_id) AS n FROM documents d LEFT JOIN spans s USING (doc_id) GROUP BY 1")
ORACLES["spans_by_source"] = with_spans("SELECT 'regex' AS source, count(*) AS n FROM spans")
_CONFIGS = [("0.5", "5", "false", "off"), ("0.7", "5", "false", "full"), ("0.5", "5", "false", "off"), ("0.5", "2", "true", "off"), ("0.5", "5", "false", "off")]
ORACLES["config_parsed"] = f"""SELECT id, m::DOUBLE AS min_confidence, 0.15::DOUBLE AS context_boost, w::INT AS context_window, n::BOOLEAN AS ner_enabled, c AS code_mode, true AS regex_enabled FROM {fixtures.each_sql(_CONFIGS, 'm, w, n, c')}"""
PAGES = "(SELECT page_id AS k, url AS u FROM pages)"
ORACLES["url_parts"] = f"WITH {url_table(PAGES)} SELECT k AS page_id, scheme, host, path, query, fragment FROM parts"
ORACLES["url_private_flag"] = f"WITH {url_table(PAGES)} SELECT k AS page_id, {private_flag()} AS private FROM parts"
ORACLES["url_private_fixture"] = f"WITH {url_table('(SELECT id AS k, url AS u FROM ' + fixtures.each_sql([(u,) for u in fixtures.URLS], 'url') + ')')} SELECT k AS id, {private_flag(['unknown.biz'])} AS private FROM parts"
ORACLES["path_private_fixture"] = f"SELECT id, {private_path('path')} AS private FROM {fixtures.each_sql([(p,) for p in fixtures.PATHS], 'path')}"
ORACLES["url_hosts_topk"] = f"WITH {url_table(PAGES)} SELECT host, count(*) AS n FROM parts GROUP BY host ORDER BY n DESC, host LIMIT 10"
ORACLES["thresholded_global"] = with_spans(f"SELECT doc_id, start, entity_type, score FROM spans WHERE score >= {threshold_case(0.1)}")
ORACLES["thresholded_individual"] = with_spans(f"SELECT doc_id, start, entity_type, score FROM spans WHERE score >= {threshold_case(0.5, {'Contact': 0.0, 'Network': 1.0})}")
ORACLES["group_filtered"] = with_spans("SELECT doc_id, start, entity_type FROM spans WHERE entity_type NOT IN ('DATE', 'MISC')")
ORACLES["allowlist_filtered"] = with_spans(r"SELECT doc_id, start, entity_type, text FROM spans WHERE NOT regexp_full_match(text, '(?i)[A-Za-z0-9_]+@[A-Za-z0-9_]+\.example\.com|192\.168\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+')")
ORACLES["blocklist_injected"] = """WITH g AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS t FROM documents WHERE regexp_matches(text, '(?i)das')),
w AS (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM g)
SELECT doc_id, CAST(strlen(array_to_string(t[:i - 1], '')) AS INT) AS start, CAST(strlen(array_to_string(t[:i - 1], '')) AS INT) + 3 AS "end", 'PERSON' AS entity_type, CAST(1.0 AS DOUBLE) AS score, t[i] AS text FROM w WHERE lower(t[i]) = 'das'"""
FEEDBACK = """f AS (SELECT CASE WHEN event_id % 3 < 2 THEN CASE WHEN user_id % 2 = 0 THEN 'EMAIL' ELSE 'PHONE' END END AS detected_type,
   CASE WHEN event_id % 3 = 0 THEN 'NOT_PII' ELSE CASE WHEN user_id % 2 = 0 THEN 'EMAIL' ELSE 'PHONE' END END AS corrected_type FROM events),
k AS (SELECT coalesce(detected_type, corrected_type) AS entity_type, CASE WHEN corrected_type = 'NOT_PII' THEN CAST(1.0 AS DOUBLE) ELSE 0.0 END AS d FROM f
      WHERE (detected_type IS NOT NULL AND corrected_type = 'NOT_PII') OR (detected_type IS NULL AND corrected_type <> 'NOT_PII'))"""
ORACLES["adaptive_thresholds"] = f"WITH {FEEDBACK} SELECT entity_type, round(greatest(0.1, least(0.99, 0.5 + (avg(d) - 0.5) * 0.4)), 9) AS threshold FROM k GROUP BY 1"
ORACLES["adaptive_filtered"] = f"WITH {ALL}, {FEEDBACK}, t AS (SELECT entity_type, greatest(0.1, least(0.99, 0.75 + (avg(d) - 0.5) * 0.4)) AS threshold FROM k GROUP BY 1) SELECT entity_type, count(*) AS n FROM spans LEFT JOIN t USING (entity_type) WHERE score >= coalesce(threshold, 0.5) GROUP BY 1"
ORACLES["known_replacement_drop"] = with_spans("SELECT doc_id, start, text FROM spans WHERE trim(text) NOT IN (SELECT trim(text) FROM spans WHERE doc_id % 2 = 0)")
ORACLES["list_conflicts"] = "SELECT lower(n_name) AS allowed, ' ' || n_name || '  ' AS blocked FROM nation WHERE n_nationkey % 2 = 0"

NUMBERED = """firsts AS (SELECT doc_id, text AS original, arg_min(entity_type, (start, entity_type)) AS entity_type, min(start) AS start FROM spans GROUP BY doc_id, text),
tokens AS (SELECT doc_id, original, entity_type, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start, original) || ']' AS token FROM firsts)"""
ORACLES["entity_map"] = f"WITH {ALL}, {NUMBERED} SELECT doc_id, original, entity_type, token FROM tokens"


def redacted(join: str) -> str:
    """doc_id, redacted: cut between spans, replaced by token (of join)."""
    return f"""cuts AS (SELECT s.doc_id, s.start, s."end", coalesce(lag(s."end") OVER (PARTITION BY s.doc_id ORDER BY s.start), 0) AS prior, lead(s.start) OVER (PARTITION BY s.doc_id ORDER BY s.start) AS later, t.token FROM spans s JOIN {join}),
raw AS (SELECT c.*, encode(d.text) AS b FROM cuts c JOIN documents d USING (doc_id)),
pieces AS (SELECT doc_id, start, decode(array_slice(b, prior + 1, start)) || token || CASE WHEN later IS NULL THEN decode(array_slice(b, "end" + 1, octet_length(b))) ELSE '' END AS piece FROM raw),
red AS (SELECT doc_id, string_agg(piece, '' ORDER BY start) AS redacted FROM pieces GROUP BY doc_id)"""


ORACLES["redact_per_doc"] = f"WITH {ALL}, {NUMBERED}, {redacted('tokens t ON t.doc_id = s.doc_id AND t.original = s.text')} SELECT doc_id, redacted FROM red"
ORACLES["restore_roundtrip"] = with_spans("SELECT doc_id, text AS restored FROM documents WHERE doc_id IN (SELECT doc_id FROM spans)")
ORACLES["restore_with_vault"] = ORACLES["restore_roundtrip"]
VAULT = r"""keyed AS (SELECT *, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS normalized_key FROM spans),
idents AS (SELECT entity_type, normalized_key, min((doc_id, start)) AS f, count(*) AS usage_count FROM keyed GROUP BY 1, 2),
vault AS (SELECT entity_type, normalized_key, row_number() OVER (PARTITION BY entity_type ORDER BY f, normalized_key) AS index, usage_count FROM idents)"""
ORACLES["vault_numbering"] = ORACLES["stream_vault"] = f"WITH {ALL}, {VAULT} SELECT entity_type, normalized_key, '[' || entity_type || '_' || index || ']' AS placeholder, index, usage_count FROM vault"
ORACLES["vault_extended"] = f"""WITH {ALL}, {VAULT.split(',' + chr(10) + 'idents')[0]},
idents AS (SELECT entity_type, normalized_key, min((doc_id % 2, doc_id, start)) AS f, count(*) AS usage_count FROM keyed GROUP BY 1, 2)
SELECT entity_type, normalized_key, row_number() OVER (PARTITION BY entity_type ORDER BY f, normalized_key) AS index, usage_count FROM idents"""
ORACLES["redact_with_vault"] = f"""WITH {ALL}, {VAULT}, tokens AS (SELECT k.doc_id, k.start, '[' || v.entity_type || '_' || v.index || ']' AS token FROM keyed k JOIN vault v USING (entity_type, normalized_key)),
{redacted('tokens t ON t.doc_id = s.doc_id AND t.start = s.start')} SELECT doc_id, redacted FROM red"""
CHATS = """chats AS (SELECT conv_id, turn, concat_ws(' ', text, '[PERSON_' || (conv_id % 7 + 1) || ']', '[EMAIL_' || (turn + 1) || ']', '[NOPE_1]') AS text FROM conversations)"""
ORACLES["observed_tokens"] = f"""WITH {CHATS} SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\\[[A-Z]+(?:_[A-Z]+)*_[0-9]+\\]'))) AS token FROM chats) WHERE token <> '[NOPE_1]' GROUP BY token"""
ORACLES["history_best_match"] = f"""WITH {CHATS}, seen AS (SELECT conv_id AS reply_id, unnest(list_distinct(regexp_extract_all(text, '\\[[A-Z]+(?:_[A-Z]+)*_[0-9]+\\]'))) AS token FROM chats WHERE turn = 0),
entries AS (SELECT i AS entry_id, unnest(['[PERSON_' || i || ']', '[EMAIL_' || (i % 2 + 1) || ']']) AS token FROM generate_series(1, 7) g(i)),
hits AS (SELECT reply_id, entry_id, count(DISTINCT token) AS hits FROM seen JOIN entries USING (token) GROUP BY 1, 2)
SELECT reply_id, entry_id, hits FROM hits QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY hits DESC, entry_id DESC) = 1"""
ORACLES["conversation_scope"] = f"""WITH {CHATS}, t AS (SELECT DISTINCT conv_id AS scope, unnest(regexp_extract_all(text, '\\[[A-Z]+(?:_[A-Z]+)*_[0-9]+\\]')) AS token FROM chats)
SELECT scope, token, lower(token) AS original, NOT (scope % 2 = 0 OR scope % 3 = 0) AS strict FROM t WHERE token <> '[NOPE_1]'"""
ORACLES["exact_copies"] = r"SELECT doc_id AS text_id, max(doc_id) OVER (PARTITION BY regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')) AS entry_id FROM documents"
BUCKET = "CASE WHEN {0} <= 120 THEN 'short' WHEN {0} <= 260 THEN 'medium' ELSE 'long' END"
ORACLES["length_buckets"] = f"SELECT {BUCKET.format('length(text)')} AS bucket, CASE WHEN lang IN ('en', 'de') THEN lang END AS language, count(*) AS n FROM documents GROUP BY ALL"
ORACLES["corpus_summary"] = with_spans(
    f"""SELECT 'language' AS dimension, lang AS value, count(*) AS examples FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL
UNION ALL SELECT 'length_bucket', {BUCKET.format('length(text)')}, count(*) FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL
UNION ALL SELECT 'entity_type', entity_type, count(DISTINCT doc_id) FROM spans JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY ALL"""
)
ORACLES["negative_quota"] = with_spans(
    f"""SELECT id, bucket FROM (SELECT doc_id AS id, lang || ':' || {BUCKET.format('length(text)')} AS bucket FROM documents WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM spans))
QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY id) <= CASE WHEN bucket = 'en:short' THEN 5 ELSE 4 END ORDER BY id LIMIT 25"""
)
ORACLES["label_map"] = "SELECT id, entity_type FROM " + fixtures.each_sql([(x,) for x in ("PERSON", "PERSON", None, "PERSON", "MISC", None, None, "MISC", "MISC")], "entity_type")
#: The planted shifts are 0, 1 or 10 bytes, so a detection can match its own gold span only, unless spans are closer than that.
SCORED = f"""rows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS idx, start, "end", entity_type, start + doc_id AS k FROM spans),
shifted AS (SELECT *, CASE WHEN k % 11 = 0 THEN 10 WHEN k % 5 = 0 THEN 1 ELSE 0 END AS moved, "end" - start AS n FROM rows),
pairs AS (SELECT *, k % 7 <> 0 AS gold, moved <= 2 AND (n - moved) / n >= 0.8 AND (n - moved) / n >= 0.5 AS hit, CASE WHEN k % 13 = 0 THEN 'MISC' ELSE entity_type END AS found_type FROM shifted),
kinds AS (SELECT doc_id, CASE WHEN count(*) FILTER (gold) = 0 THEN 'negative' WHEN count(*) FILTER (gold AND entity_type = 'MISC') > 0 THEN 'misc' ELSE 'headline' END AS kind FROM pairs GROUP BY doc_id),
ev AS (SELECT doc_id, entity_type, 'tp' AS event, entity_type = found_type AS ok FROM pairs WHERE gold AND hit
       UNION ALL SELECT doc_id, entity_type, 'fn', NULL FROM pairs WHERE gold AND NOT hit UNION ALL SELECT doc_id, found_type, 'fp', NULL FROM pairs WHERE NOT (gold AND hit)),
head AS (SELECT ev.*, d.lang AS language, {BUCKET.format('length(d.text)')} AS length_bucket FROM ev JOIN kinds USING (doc_id) JOIN documents d USING (doc_id) WHERE kind = 'headline')"""
COUNTS = "count(*) FILTER (event = 'tp') AS tp, count(*) FILTER (event = 'fp') AS fp, count(*) FILTER (event = 'fn') AS fn"
RATES = "tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall"
F1 = "*, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1"
ORACLES["score_headline"] = f"WITH {ALL}, {SCORED}, n AS (SELECT {COUNTS} FROM head), r AS (SELECT {RATES} FROM n) SELECT {F1} FROM r"
for name, col, values in (("score_by_type", "entity_type", rules.ENTITY_TYPES), ("score_by_lang", "language", ["en", "de", "fr", "es", "it"]), ("score_by_bucket", "length_bucket", ["short", "medium", "long"])):
    ORACLES[name] = f"""WITH {ALL}, {SCORED}, v AS (SELECT unnest({listed(values)}) AS {col}), g AS (SELECT {col}, {COUNTS} FROM head GROUP BY {col}),
n AS (SELECT v.{col}, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM v LEFT JOIN g USING ({col})), r AS (SELECT {col}, {RATES} FROM n) SELECT {F1} FROM r"""
ORACLES["type_accuracy"] = f"WITH {ALL}, {SCORED} SELECT count(*) AS matched, coalesce(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0 END), 0.0) AS accuracy FROM head WHERE event = 'tp'"
ORACLES["negative_behaviour"] = f"""WITH {ALL}, {SCORED}, neg AS (SELECT d.doc_id, coalesce(p.n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (gold) AS g FROM pairs GROUP BY doc_id) p USING (doc_id) WHERE coalesce(p.g, 0) = 0)
SELECT count(*) AS examples, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed, count(*) FILTER (n = 0) / count(*) AS pass_rate, CAST(sum(n) AS BIGINT) / count(*) AS fp_rate, CAST(sum(n) AS BIGINT) AS false_positives FROM neg"""
ORACLES["false_negatives"] = f"WITH {ALL}, {SCORED} SELECT doc_id AS example_id, CAST(idx AS INT) AS idx, start, entity_type FROM pairs WHERE gold AND NOT hit"
ORACLES["false_positives"] = f"WITH {ALL}, {SCORED} SELECT doc_id AS example_id, CAST(idx AS INT) AS idx, start + moved AS start, found_type AS entity_type FROM pairs WHERE NOT (gold AND hit)"
ORACLES["latency_nearest_rank"] = "SELECT event_type, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS average, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type"
ORACLES["identifier_evidence"] = """WITH p AS (SELECT l_returnflag || l_linestatus AS name, l_suppkey % 10 AS t, sum(floor(CAST(l_quantity AS DOUBLE))) / (sum(floor(CAST(l_quantity AS DOUBLE))) + sum(CAST(l_linenumber AS DOUBLE))) AS share FROM lineitem GROUP BY ALL)
SELECT name, round(min(share), 9) AS share, min(share) >= 0.8212717771530151 AS library FROM p GROUP BY name"""
ORACLES["hash_splits"] = "SELECT source, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT source, list_reduce(list_prepend(0, list_transform(string_split(sha1(source), ''), lambda c: CAST('0x' || c AS INT))), lambda r, c: (r * 16 + c) % 10) AS b FROM documents)"
ORACLES["content_dedup"] = "SELECT source, least(count(*), 20) AS n FROM (SELECT text, min(source) AS source FROM documents GROUP BY text) GROUP BY source"
ORACLES["name_tokens"] = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
PRIVATE_LINKS = [
    (4, "https://intranet.corp/wiki"), (4, "http://10.0.0.5:8080/x"), (6, "https://acme.sharepoint.com/sites/hr"), (6, "https://github.com/a/b?access_token=abc"), (6, "https://linkedin.com/in/someone"),
    (10, "https://user:pw@host.example.com/"), (10, "https://example.com/u/550e8400-e29b-41d4-a716-446655440000"), (10, "https://drive.google.com/file"), (10, "https://unknown-host.biz/page"),
]
_at = [(i, dict(fixtures.TEXTS)[i].encode().find(u.encode()), u) for i, u in PRIVATE_LINKS]
ORACLES["private_links_in_text"] = 'SELECT id, start, "end", v.text FROM ' + FIXTURE + " f JOIN " + fixtures.values([(i, a, a + len(u), u) for i, a, u in _at], 'case_id, start, "end", text') + " USING (case_id)"
ORACLES["domains_normalized"] = r"SELECT page_id, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/:?#]+)', 1) AS domain FROM pages"
ORACLES["chunk_merge"] = f"""WITH {candidates()} SELECT doc_id, start, start + CAST(strlen(m) AS INT) AS "end", entity_type, m AS text FROM cand WHERE entity_type IN ('EMAIL', 'IP_ADDRESS')"""
ORACLES["model_labels"] = "SELECT id, entity_type FROM " + fixtures.each_sql([(x,) for x in ("PERSON", "LOCATION", "PERSON", "ORGANIZATION", None, None, None)], "entity_type")
ORACLES["code_tags"] = "SELECT i = 0 AS in_code, CASE i WHEN 0 THEN '10.1.2.3' ELSE '10.9.8.7' END AS text, count(*) AS n FROM conversations, generate_series(0, 1) g(i) GROUP BY ALL"
ORACLES["stream_debounce"] = """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS fires, count(*) AS n_updates FROM s GROUP BY user_id, n"""
ORACLES["stream_suppressed"] = """WITH e AS (SELECT user_id, ts, max(event_type) AS v FROM events GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM e) SELECT user_id, count(*) AS n FROM l WHERE b IS NULL OR b <> v GROUP BY user_id"""
ORACLES["token_filing"] = f"""WITH {CHATS}, t AS (SELECT unnest(regexp_extract_all(text, '\\[[A-Z]+(?:_[A-Z]+)*_[0-9]+\\]')) AS token, conv_id, conv_id * 100 + turn AS seen FROM chats)
SELECT token, arg_max(conv_id, seen) AS conversation FROM t WHERE token <> '[NOPE_1]' GROUP BY token"""
ORACLES["score_grouping_sets"] = f"WITH {ALL}, {SCORED} SELECT entity_type, language, length_bucket, {COUNTS} FROM head GROUP BY GROUPING SETS ((entity_type), (language), (length_bucket), ())"
ORACLES["usage_stats"] = f"WITH {ALL}, {VAULT.split(',' + chr(10) + 'idents')[0]} SELECT entity_type, normalized_key, count(*) AS uses, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM keyed GROUP BY ALL"
ORACLES["dataset_stats"] = f"""WITH s AS ({ORACLES["hash_splits"]}) SELECT split, count(*) AS rows, count(DISTINCT source) AS groups, count(*) FILTER (lang = 'en') AS positives, round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS share FROM documents JOIN s USING (source) GROUP BY split"""
ORACLES["history_kept"] = "SELECT conv_id AS id, max(conv_id * 100 + turn) AS created, length(arg_max(text, conv_id * 100 + turn)) > 20000 AS truncated FROM conversations GROUP BY conv_id ORDER BY created DESC LIMIT 50"
ORACLES["feedback_kept"] = "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000"
ORACLES["conversation_store"] = f"""WITH {CHATS}, t AS (SELECT DISTINCT conv_id AS conversation, unnest(regexp_extract_all(text, '\\[[A-Z]+(?:_[A-Z]+)*_[0-9]+\\]')) AS token FROM chats)
SELECT conversation, string_agg(token, ' ' ORDER BY token) AS tokens, CAST(CASE WHEN conversation % 3 = 0 THEN count(*) ELSE 0 END AS INT) AS originals FROM t WHERE token <> '[NOPE_1]' AND (conversation % 2 = 0 OR conversation % 3 = 0) GROUP BY conversation"""
ORACLES["examples_from_raw"] = f"""SELECT 'docs-' || lang || '-' || doc_id AS id, lang AS language, {BUCKET.format('length(text)')} AS bucket, 0 AS start, CAST(strlen(w) AS INT) AS "end", 'PERSON' AS entity_type, w AS text
FROM (SELECT *, regexp_extract(text, '^[^\\s]+') AS w FROM documents WHERE lang IN ('en', 'de')) WHERE w <> ''"""
ORACLES["auto_approved"] = with_spans("SELECT doc_id, start, score FROM spans WHERE score >= 0.8")
ORACLES["used_mappings"] = f"WITH {CHATS} SELECT '[PERSON_' || i || ']' AS token, 'p' || i AS original, count(*) AS n FROM chats, generate_series(1, 9) g(i) WHERE contains(text, 'PERSON_' || i) GROUP BY i"
ORACLES["gazetteer"] = "SELECT id, strlen(substr(t, 1, instr(t, w) - 1))::INT AS start, k AS entity_type, w AS text FROM (SELECT id::BIGINT AS id, concat_ws(' ', text, 'by Anna Müller, Berlin') AS t FROM " + FIXTURE + "), (VALUES ('Anna Müller', 'PERSON'), ('Berlin', 'LOCATION')) AS g(w, k)"
ORACLES["code_alias"] = "SELECT id, alias FROM " + fixtures.each_sql([(x,) for x in ("var1", "_field2", "Field3", "CONST_4", "func_5", "Class6", "param7")], "alias")

#: Text between tags; comments and what pages don't show are cut out first. The pages have four kinds of references.
ORACLES["page_transcripts"] = r"""
WITH cut AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<>', 'g'), '(?si)<script\b.*?</script>', '<>', 'g'), '(?si)<style\b.*?</style>', '<>', 'g') AS h FROM pages),
nodes AS (SELECT page_id, html, list_transform(string_split_regex(h, '<[^>]*>'), lambda t: regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g')) AS t FROM cut)
SELECT page_id, CASE WHEN html IS NOT NULL THEN array_to_string(list_filter(t, lambda x: x <> ''), chr(10)) END AS text FROM nodes"""


def pooled(values: list[str]) -> str:
    """The pool's value for index; later rounds have their number behind a blank or dash."""
    value, n = f"{listed(values)}[1 + (index - 1) % {len(values)}]", len(values)
    return f"({value} || CASE WHEN index > {n} THEN CASE WHEN regexp_full_match({value}, '[0-9\\s+\\-()]+') THEN '-' ELSE ' ' END || CAST((index - 1) // {n} + 1 AS VARCHAR) ELSE '' END)"


_LOCAL = f"regexp_replace(regexp_replace(lower({pooled(rules.POOLS['PERSON'])}), '[^a-z0-9]+', '.', 'g'), '^\\.+|\\.+$', '', 'g')"
_DOMAIN = f"{listed(rules.EMAIL_DOMAINS)}[1 + (index - 1) % {len(rules.EMAIL_DOMAINS)}]"
ORACLES["synthetic_values"] = f"""WITH {ALL}, {VAULT} SELECT '[' || entity_type || '_' || index || ']' AS placeholder,
CASE entity_type WHEN 'EMAIL' THEN {_LOCAL} || '@' || {_DOMAIN} {' '.join(f"WHEN '{t}' THEN {pooled(v)}" for t, v in rules.POOLS.items() if t != 'EMAIL')} ELSE '' END AS synthetic_value FROM vault"""

# ---- code planted in documents: what the templates of plans/planted.py must give, {0} to {3} being a document's words

_KIND = f"coalesce((doc_id % {len(planted.PIECES)} + {len(planted.PIECES)}) % {len(planted.PIECES)}, 0)"
CODED = f"coded AS MATERIALIZED (SELECT doc_id, {_KIND} AS kind, {planted.sql_words()} AS w, text FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')[1:4] AS f FROM documents))"


def filled(column: str) -> str:
    for k in range(4):
        column = f"replace({column}, '{{{k}}}', w[{k + 1}])"
    return column


def per_kind(rows: list[tuple], names: str, texts: str) -> str:
    """Rows (kind, ...) for each document of that kind; the columns in texts have its words put in."""
    out = ", ".join(f"{filled('v.' + c)} AS {c}" if c in texts.split() else f"v.{c}" for c in names.split(", "))
    return f"WITH {CODED} SELECT doc_id, {out} FROM coded JOIN {fixtures.values(rows, 'kind, ' + names)} USING (kind)"


_PLAIN = [p.replace("{{", "\x01").replace("}}", "\x02") for p in planted.PIECES]
_SIZES = [len(p.replace("\x01", "{").replace("\x02", "}")) - 3 * sum(p.count(f"{{{k}}}") for k in range(4)) for p in _PLAIN]
#: Bytes of a piece: what is fixed, and each word as often as it stands there.
_BYTES = "CASE kind " + " ".join(f"WHEN {k} THEN {_SIZES[k]} + " + " + ".join(f"{p.count('{%d}' % n)} * strlen(w[{n + 1}])" for n in range(4)) for k, p in enumerate(_PLAIN)) + " END"
_MARK = "strlen('<code>{0}_{1} = {2}({3})</code>') - 12 + strlen(w[1]) + strlen(w[2]) + strlen(w[3]) + strlen(w[4])"
ORACLES["code_regions"] = f"""WITH {CODED} SELECT doc_id, CAST(CASE kind WHEN 5 THEN 4 ELSE 0 END AS INT) AS start, CAST(CASE kind WHEN 5 THEN {_MARK} WHEN 4 THEN {_BYTES} - strlen(w[3]) - {len(chr(10) + "ValueError: bad '_id'")} ELSE {_BYTES} END AS INT) AS bytes,
CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'go' ELSE 'unknown' END AS language FROM coded"""
ORACLES["marked_regions"] = f"""WITH {CODED}, r AS (SELECT *, CAST(strlen(text) + CASE kind WHEN 5 THEN 6 ELSE 2 END AS INT) AS start FROM coded WHERE kind <> 4)
SELECT doc_id, start, CAST(start + CASE kind WHEN 5 THEN {_MARK} ELSE {_BYTES} END AS INT) AS "end" FROM r"""
_SLOTS = [
    (4, "ValueError", "type", False), (4, "/home/{0}/app/main.py", "path", False), (4, "run", "function", True), (4, "/usr/lib/python3/site-packages/a.py", "path", True), (4, "{2}_id", "mention", False), (4, "load_{1}", "function", False),
    (5, "src/{0}.ts", "path", False), (5, "{1}Name", "mention", False),
]
ORACLES["error_slots"] = f"SELECT doc_id, CAST(strlen(name) AS INT) AS bytes, name, slot AS kind, library FROM ({per_kind(_SLOTS, 'name, slot, library', 'name')})"
ORACLES["language_guess"] = per_kind([(0, "python"), (1, "javascript"), (2, "java"), (3, "go")], "languages", "")
ORACLES["profiles"] = per_kind([(0, "pandas"), (1, "react"), (2, ""), (3, ""), (4, ""), (5, "")], "profiles", "")
#: kind, name, role, the step that decides, and its alias, if it is one's own.
_NAMES = [
    (0, "load_{0}", "function", "declared", "func_1"), (0, "{1}_name", "parameter", "declared", "param_2"), (0, "limit", "parameter", "declared", "param3"), (0, "{2}_total", "variable", "declared", "var_4"), (0, "{3}_row", "variable", "declared", "var_5"),
    (0, "{0}_key", "property", "undeclared", "field_6"), (0, "render_{3}", "function", "undeclared", "func_7"), (0, "pandas", "variable", "imported", None), (0, "pd", "variable", "imported", None), (0, "os", "variable", "imported", None),
    (0, "environ", "variable", "imported", None), (0, "read_csv", "function", "receiver", None), (0, "head", "function", "receiver", None), (0, "sep", "property", "option", None),
    (1, "{0}Name", "variable", "declared", "var1"), (1, "{1}Url", "variable", "undeclared", "var2"), (1, "{2}Data", "parameter", "declared", "param3"), (1, "show{3}", "function", "undeclared", "func4"), (1, "load{1}", "function", "declared", "func5"),
    (1, "id", "parameter", "declared", "param6"), (1, "{3}Box", "variable", "undeclared", "var7"), (1, "useState", "variable", "imported", None), (1, "$", "function", "lexicon", None), (1, "addClass", "function", "receiver", None), (1, "ajax", "function", "receiver", None),
    (1, "url", "property", "option", None), (1, "success", "property", "option", None), (1, "console", "variable", "lexicon", None), (1, "log", "function", "receiver", None), (1, "fetch", "function", "lexicon", None),
    (2, "{0}Service", "class", "declared", "Class1"), (2, "{1}Base", "class", "undeclared", "Class2"), (2, "{2}Count", "property", "declared", "field3"), (2, "{3}Order", "variable", "verdict", "var4"), (2, "load{0}", "function", "declared", "func5"),
    (2, "{1}Id", "parameter", "declared", "param6"), (2, "{3}Parts", "variable", "declared", "var7"), (2, "helper", "variable", "fallback", "var8"), (2, "split", "function", "undeclared", "func9"), (2, "java", "variable", "imported", None),
    (2, "util", "property", "imported", None), (2, "List", "class", "imported", None), (2, "IOException", "class", "lexicon", None),
    (3, "{0}Total", "function", "declared", "func1"), (3, "{1}Items", "parameter", "declared", "param2"), (3, "{2}Sum", "variable", "declared", "var3"), (3, "{3}Price", "variable", "declared", "var4"), (3, "main", "namespace", "reserved", None),
    (3, "fmt", "variable", "imported", None), (3, "_", "variable", "reserved", None), (3, "Println", "function", "receiver", None),
    (4, "load_{1}", "function", "declared", "func_1"), (5, "{0}_{1}", "variable", "declared", "var_1"), (5, "{2}", "function", "undeclared", "func2"), (5, "{3}", "variable", "undeclared", "var3"),
]
ORACLES["code_symbols"] = per_kind([(k, n, role, step, step in ("declared", "undeclared")) for k, n, role, step, _ in _NAMES], "name, role, step, own", "name")
ORACLES["rename_plan"] = per_kind([(k, n, alias) for k, n, _, _, alias in _NAMES if alias], "name, alias", "name")


def _redacted(kind: int) -> str:
    """A piece with its own names' aliases; names that hold others first. Words that are left stay as they are."""
    out = _PLAIN[kind]
    for _, n, _, _, alias in sorted((r for r in _NAMES if r[0] == kind and r[4]), key=lambda r: -len(r[1])):
        out = re.sub(r"(?<![\w{}/$])" + re.escape(n) + r"(?![\w{}])(?!/)", alias, out)
    return out.replace("\x01", "{").replace("\x02", "}")


ORACLES["redact_code"] = f"SELECT doc_id, sha256(code) AS code FROM ({per_kind([(k, _redacted(k)) for k in range(len(planted.PIECES))], 'code', 'code')})"
_VIEW = r"replace(replace(replace(regexp_replace(regexp_replace(code, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '_', ' '), '$(', chr(1)), chr(1), '$(')"
ORACLES["split_identifiers"] = f"SELECT doc_id, {_VIEW} AS view FROM ({per_kind([(k, _PLAIN[k].replace(chr(1), '{').replace(chr(2), '}')) for k in range(4)], 'code', 'code')})"
ORACLES["identifiers_propagated"] = f"SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(strlen(before) AS INT) AS first FROM ({per_kind([(0, 3, _PLAIN[0].split('{1}')[0]), (1, 1, _PLAIN[1].split('{1}')[0]), (2, 3, _PLAIN[2].split('{1}')[0]), (3, 2, _PLAIN[3].split('{1}')[0])], 'n, before', 'before')})".replace("\x01", "{").replace("\x02", "}")
ORACLES["identifiers_widened"] = f"SELECT doc_id, text, CAST(n AS BIGINT) AS n FROM ({per_kind([(0, '{1}_name', 3), (1, '{1}Url', 1), (2, '{1}Base', 1), (3, '{1}Items', 2)], 'text, n', 'text')})"
ORACLES["generic_dropped"] = per_kind([(0, "total", "regex")], "text, source", "")
ORACLES["bare_positions"] = per_kind([(k, True) for k in range(4)], "bare", "")
ORACLES["path_views"] = f"WITH {CODED} SELECT doc_id, ' home ' || w[1] || ' ' || w[2] || '.' || w[3] AS view FROM coded"
#: What of a type has no synthetic value keeps its placeholder.
_SYNTHETIC = listed([*rules.POOLS, "EMAIL", "URL", "FILE_PATH"])
ORACLES["vault_edits"] = f"""WITH {ALL}, {VAULT} SELECT entity_type, normalized_key, index, CASE WHEN index % 3 = 0 AND index % 6 <> 0 AND list_contains({_SYNTHETIC}, entity_type) THEN 'synthetic' ELSE 'placeholder' END AS mode,
index % 3 = 0 AS pinned, CASE WHEN index % 3 = 0 THEN 'seen' END AS notes, CAST(CASE WHEN index % 6 = 0 THEN 4 WHEN index % 3 = 0 THEN 2 ELSE 1 END AS INT) AS updated FROM vault WHERE index % 5 <> 0"""
ORACLES["vault_reverse"] = f"""WITH {ALL}, {VAULT}, firsts AS (SELECT entity_type, normalized_key, arg_min(text, (doc_id, start)) AS original_text FROM keyed GROUP BY ALL)
SELECT '[' || entity_type || '_' || index || ']' AS token, original_text FROM vault JOIN firsts USING (entity_type, normalized_key)"""
_OWN = [(k, n) for k, n, _, step, alias in _NAMES if alias and step in ("declared", "undeclared")] + [(2, "{3}Order"), (2, "helper")]
_USES = [(k, n, sum(len(re.findall(r"(?<![\w{}/$])" + re.escape(n) + r"(?![\w{}])", line.split("# ")[0])) for line in (_PLAIN[k].split("\n") if k != 4 else ["load_{1}"])[: None if k != 5 else 1])) for k, n in _OWN]
ORACLES["alias_allocation"] = f"SELECT name, true AS unique, true AS free, CAST(sum(n) AS BIGINT) AS uses FROM ({per_kind(_USES, 'name, n', 'name')}) GROUP BY name"
ORACLES["rename_preview"] = f"SELECT DISTINCT name, true AS same FROM ({per_kind(_OWN, 'name', 'name')})"
_PASSED = "epoch_ms((SELECT max(ts) FROM events)) - 3600000"
ORACLES["stream_debounce_live"] = f"""WITH d AS (SELECT DISTINCT user_id, ts FROM events), e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS fires, count(*) AS n_updates FROM s GROUP BY user_id, n HAVING epoch_ms(max(ts) + INTERVAL 10 MINUTE) <= {_PASSED}"""
ORACLES["stream_suppressed_live"] = f"""WITH e AS (SELECT user_id, ts, max(event_type) AS v FROM events GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM e)
SELECT user_id, count(*) AS n FROM l WHERE (b IS NULL OR b <> v) AND epoch_ms(ts) + 1 <= {_PASSED} GROUP BY user_id"""
ORACLES["token_chunks"] = "SELECT doc_id, true AS fits, true AS covers FROM documents WHERE text <> ''"
#: A model's PERSON needs 0.55.
ORACLES["external_spans"] = r"""SELECT doc_id, CAST(0 AS INT) AS start, CAST(strlen(w) AS INT) AS "end", 'PERSON' AS entity_type, score, w AS text
FROM (SELECT doc_id, regexp_extract(text, '^[^\s]+') AS w, CASE WHEN doc_id % 9 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS score FROM documents WHERE doc_id % 6 = 0) WHERE w <> '' AND score >= 0.55"""
