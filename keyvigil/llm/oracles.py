"""SQL of the corpus queries that SQL can express, read straight from their contracts."""

from keyvigil.llm import licenses

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
TRIM = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUBSTRINGS = f"""
WITH words AS (
  SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM documents
),
windows AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER w) AS content, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
),
repeated AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY content) AS copies FROM windows WHERE n = 35
  ) WHERE copies > 1
),
marked AS (
  SELECT words.doc_id, words.pos, words.word, max(repeated.pos) OVER (
      PARTITION BY words.doc_id ORDER BY words.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN repeated ON words.doc_id = repeated.doc_id AND words.pos = repeated.pos
),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS content
  FROM marked GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(content, '')) AS kept_sha256
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id
"""

LINES = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
each AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
),
keyed AS (
  SELECT *, translate({TRIM.format("line")}, '{UPPER}', '{UPPER.lower()}') AS key FROM each
),
shared AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
),
marked AS (
  SELECT doc_id, pos, line, first_id IS NOT NULL AND first_id <> doc_id AS gone
  FROM keyed LEFT JOIN shared ON keyed.key = shared.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# The limits are those of quality_rules: 50 documents and 1 percent of the host, 50 words and half of the text left.
QUALITY = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, source AS host, {WORDS} AS words FROM documents
),
word_rows AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
),
windows AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third
  FROM word_rows WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
counted AS (
  SELECT doc_id, pos, third IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, second, third) > 1 AS twice FROM windows
),
covered AS (
  SELECT doc_id, coalesce(bool_or(twice) OVER (
      PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS inside FROM counted
),
repeats AS (
  SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY doc_id
),
line_rows AS (
  SELECT doc_id, host, md5(text) AS content, line, lower({TRIM.format("line")}) AS norm,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE {TRIM.format("line")} <> ''
),
doubled AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line_rows GROUP BY doc_id
),
hosts AS (
  SELECT host, count(DISTINCT md5(text)) AS host_docs FROM docs GROUP BY host
),
boilerplate AS (
  SELECT line_rows.host, norm, min(doc_id) AS first_id
  FROM line_rows JOIN hosts ON line_rows.host IS NOT DISTINCT FROM hosts.host
  GROUP BY line_rows.host, norm, host_docs
  HAVING count(DISTINCT content) > 50 AND count(DISTINCT content) > 0.01 * host_docs
),
lost AS (
  SELECT doc_id, sum(n) AS n_boilerplate
  FROM line_rows JOIN boilerplate ON line_rows.host IS NOT DISTINCT FROM boilerplate.host AND line_rows.norm = boilerplate.norm
  WHERE doc_id <> first_id GROUP BY doc_id
),
figures AS (
  SELECT docs.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate
  FROM docs LEFT JOIN repeats ON docs.doc_id = repeats.doc_id
  LEFT JOIN doubled ON docs.doc_id = doubled.doc_id LEFT JOIN lost ON docs.doc_id = lost.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boilerplate,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (n_boilerplate > 0 AND n_words - n_boilerplate < 50 AND n_words - n_boilerplate < 0.5 * n_words) AS kept
FROM figures
"""


def _personal_data() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b",
    }
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = (
        f"(SELECT sum(CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 FROM ("
        f"SELECT i, substr(reverse({digits}), i, 1)::INT AS d FROM range(1, 20) t(i) WHERE i <= length({digits})))"
    )
    turned = "(substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4))"
    value = f"CASE WHEN substr({turned}, i, 1) BETWEEN '0' AND '9' THEN substr({turned}, i, 1) ELSE (ascii(substr({turned}, i, 1)) - 55)::VARCHAR END"
    number = f"(SELECT string_agg(v, '' ORDER BY i) FROM (SELECT i, {value} AS v FROM range(1, 80) t(i) WHERE i <= length({turned})))"
    nines = (  # nine digits at a time, as decimals hold 38 at most
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({number}, ''), lambda c: c::BIGINT)), lambda a, c: (a * 10 + c) % 97) = 1"
    )
    checks = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND lpad(ltrim(p, '0'), 3, '0') <= '255'))",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": nines,
    }
    parts = []
    for rank, (kind, pattern) in enumerate(plain.items()):
        parts.append(f"""
SELECT doc_id, text, {rank} AS rank, '{kind}' AS kind, hit, upto - length(hit) AS start, upto AS stop FROM (
  SELECT doc_id, text, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM (
    SELECT doc_id, text, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits,
             regexp_split_to_array(coalesce(text, ''), '{pattern}') AS gaps FROM documents)))
WHERE {checks[kind]}""")
    # Base score, more with a word of the kind nearby, less with a word that speaks against it.
    words = {
        "email": (0.7, "mail|contact|write to|reach"), "ip": (0.5, r"\bip\b|server|host|address|login"),
        "card": (0.7, "card|visa|credit|debit|payment|cvv"), "phone": (0.5, "phone|tel|call|mobile|fax|whatsapp"),
        "iban": (0.8, "iban|bank|account|transfer|konto"),
    }
    near = "lower(substr(text, greatest(start - 40, 0) + 1, stop - greatest(start - 40, 0) + 40))"
    against = r"example|sample|version|\bisbn\b|placeholder"
    score = " ".join(
        f"WHEN '{kind}' THEN {base} + CASE WHEN regexp_matches({near}, '{more}') THEN 0.2 ELSE 0 END"
        for kind, (base, more) in words.items()
    )
    return f"""
WITH spotted AS ({' UNION ALL '.join(parts)}),
found AS (
  SELECT *, round((CASE kind {score} END)
      - CASE WHEN regexp_matches({near}, '{against}') THEN 0.2 ELSE 0 END, 2)::DOUBLE::VARCHAR AS score FROM spotted
),
listed AS (
  SELECT doc_id,
         count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans,
         string_agg(score, ',' ORDER BY rank, start) AS scores
  FROM found GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
       coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents LEFT JOIN listed ON documents.doc_id = listed.doc_id
"""



def _codes() -> str:
    """Vector codes: rounds one after the other, distances from dot products of whole numbers (exact as doubles)."""
    nearest = """
a{k} AS (
  SELECT rn, p, min({{'d': list_dot_product(c, c) - 2 * list_dot_product(x, c), 'e': e}}) AS best
  FROM parts JOIN b{k} USING (p) GROUP BY rn, p
)"""
    book = """
m{k} AS (
  SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS v
  FROM (SELECT parts.p, best, x, unnest(range(1, len(x) + 1)) AS i FROM parts JOIN a{j} ON parts.rn = a{j}.rn AND parts.p = a{j}.p)
  GROUP BY p, best.e, i
),
b{k} AS (
  SELECT b{j}.p, b{j}.e, coalesce(n.c, b{j}.c) AS c
  FROM b{j} LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM m{k} GROUP BY p, e) n ON b{j}.p = n.p AND b{j}.e = n.e
)"""
    steps = [nearest.format(k=0)]
    for k in range(1, 5):
        steps += [book.format(k=k, j=k - 1), nearest.format(k=k)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT rn, vec_id, label, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS x FROM kept, range(4) t(p)
),
b0 AS (SELECT p, rn - 1 AS e, x AS c FROM parts WHERE rn <= 256),
{",".join(steps)},
coded AS (
  SELECT parts.rn, any_value(vec_id) AS vec_id, any_value(label) AS label,
         string_agg(printf('%02x', best.e), '' ORDER BY parts.p) AS code,
         sum(best.d + list_dot_product(x, x))::BIGINT AS error
  FROM parts JOIN a4 ON parts.rn = a4.rn AND parts.p = a4.p GROUP BY parts.rn
),
flat AS (SELECT p, e, unnest(c)::BIGINT AS v, unnest(range(len(c))) AS i FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM flat) AS codebooks_sha256
FROM coded
"""


def _licences() -> str:
    """Licence notices, with the templates as tables of words and key phrases."""
    listed = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    templates = [(k, label, len(text.split()), licenses.least_places(len(text.split()))) for k, (label, text, _) in enumerate(licenses.TEMPLATES)]
    numbers = {phrase: k for k, phrase in enumerate(licenses.phrases())}
    needed = [(k, numbers[key]) for k, (_, _, keys) in enumerate(licenses.TEMPLATES) for key in keys]
    base = [(numbers[p], label) for p, label in licenses.BASE.items()]
    key_words = [(numbers[p], t, w, len(p.split())) for p in numbers for t, w in enumerate(p.split())]
    return f"""
WITH postings(word, template, place) AS (VALUES {listed(licenses.postings())}),
templates(template, label, size, least) AS (VALUES {listed(templates)}),
needed(template, phrase) AS (VALUES {listed(needed)}),
key_places(template, phrase, place) AS (VALUES {listed(licenses.key_places())}),
base(phrase, label) AS (VALUES {listed(base)}),
key_words(phrase, t, word, size) AS (VALUES {listed(key_words)}),
known AS (SELECT word FROM postings UNION SELECT word FROM key_words),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
each AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs),
hits AS (SELECT r, word, pos FROM each WHERE word IN (SELECT word FROM known)),
keys AS (
  SELECT r, phrase, pos - t AS pos FROM hits JOIN key_words USING (word) GROUP BY r, phrase, pos - t HAVING count(*) = max(size)
),
df AS (SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word),
chosen AS (
  SELECT r, word FROM (
    SELECT r, word, n, row_number() OVER (PARTITION BY r ORDER BY n, word) AS k
    FROM (SELECT DISTINCT r, word FROM hits) JOIN df USING (word)
  ) WHERE k <= {licenses.TOP} OR n * {licenses.RARE} <= (SELECT count(*) FROM docs)
),
entries AS (
  SELECT hits.r, template, pos - place AS start, count(*) AS places
  FROM hits JOIN chosen USING (r, word) JOIN postings USING (word) GROUP BY hits.r, template, pos - place
),
verified AS (
  SELECT entries.r, entries.template, places FROM entries JOIN templates USING (template)
  WHERE places >= least
    AND EXISTS (SELECT 1 FROM key_places JOIN keys ON key_places.phrase = keys.phrase
                WHERE key_places.template = entries.template AND keys.r = entries.r AND keys.pos = entries.start + key_places.place)
    AND NOT EXISTS (SELECT 1 FROM needed WHERE needed.template = entries.template
                    AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.r = entries.r AND keys.phrase = needed.phrase))
),
of_notice AS (
  SELECT r, label, places / size AS share FROM verified JOIN templates USING (template)
),
of_base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM keys JOIN base USING (phrase) GROUP BY r
),
of_all AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM of_notice UNION SELECT r, label FROM keys JOIN base USING (phrase)) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(share, 0), 6) END::DOUBLE AS score
FROM docs LEFT JOIN of_base USING (r) LEFT JOIN of_all USING (r)
     LEFT JOIN (SELECT r, max(share) AS share FROM of_notice GROUP BY r) USING (r)
"""


LLM_ORACLES: dict[str, str] = {
    "op2_substring_dedup": SUBSTRINGS,
    "op4_line_dedup": LINES,
    "op7_quality_rules": QUALITY,
    "op9_personal_data": _personal_data(),
    "op11_vector_codes": _codes(),
    "op13_license_scan": _licences(),
}
