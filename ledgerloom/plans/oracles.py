"""DuckDB SQL for the record-processing queries."""

from ledgerloom.functions.text import ERP_WIDTHS, FREE_MAIL, LEGAL_PHRASES, SUFFIX_SPELLING
from ledgerloom.operators.validate import COUNTRIES, RULES, STATE_CODES, STATES
from ledgerloom.plans.derived import CANDIDATE_SQL, VENDOR_SQL

EMAIL = RULES["email_format"].pattern
V = f"v AS MATERIALIZED ({VENDOR_SQL})"
WS = r"'^\s+|\s+$'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, {WS}, '', 'g')"


def values(names: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def fit(x: str, w: int) -> str:
    """Cut to a width at the last space inside it."""
    head = f"substr({x}, 1, {w})"
    cut = rf"CASE WHEN regexp_matches({head}, '(?s)^.+ ') THEN regexp_replace(regexp_replace({head}, '(?s) [^ ]*\z', ''), '\s+\z', '') ELSE {head} END"
    cut = rf"regexp_replace(regexp_replace({cut}, '[,;]+\z', ''), '\s+\z', '')"
    return f"CASE WHEN length({x}) <= {w} THEN {x} ELSE coalesce(nullif({cut}, ''), {head}) END"


EMAILS = f"""em AS (
  SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, replace(lower(l[pos]), ' ', '') AS email
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{EMAIL}') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(pos))"""
DOMAIN = "regexp_replace(regexp_extract(lower(email), '^[^@]*@(.*)$', 1), '^\\.+|\\.+$', '', 'g')"

PX = "('  - ' || p_name || '  :' || chr(9) || p_brand || ' | +91-9' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '  ')"

JUDGED = f"""
SELECT packet_id, 'vendor_name' AS f, 'non_empty' AS r, 'error' AS s, trim(vendor_name) <> '' AS ok FROM v WHERE coalesce(vendor_name, '') <> ''
UNION ALL SELECT packet_id, 'gst_number', 'gstin_format', 'error', regexp_full_match(gst_number, '{RULES["gstin_format"].pattern}') FROM v WHERE coalesce(gst_number, '') <> ''
UNION ALL SELECT packet_id, 'gst_number', 'gstin_contains_pan', 'error', upper(substr(gst_number, 3, 10)) = upper(pan) FROM v WHERE coalesce(gst_number, '') <> '' AND pan <> ''
UNION ALL SELECT packet_id, 'gst_number', 'gstin_state_code', 'warning', substr(gst_number, 1, 2) IN ({values(STATE_CODES)}) FROM v WHERE coalesce(gst_number, '') <> ''
UNION ALL SELECT packet_id, 'pan', 'pan_format', 'error', regexp_full_match(pan, '{RULES["pan_format"].pattern}') FROM v WHERE pan <> ''
UNION ALL SELECT packet_id, 'pin_code', 'pin_format', 'error', regexp_full_match(pin_code, '{RULES["pin_format"].pattern}') FROM v
UNION ALL SELECT packet_id, 'state', 'indian_state', 'warning', lower(trim(state)) IN ({values([s.lower() for s in STATES])}) FROM v
UNION ALL SELECT packet_id, 'country', 'country_name', 'error', lower(trim(country)) IN ({values([s.lower() for s in COUNTRIES])}) FROM v
UNION ALL SELECT packet_id, 'email', 'email_format', 'error', regexp_full_match(email, '{EMAIL}') FROM v
UNION ALL SELECT packet_id, 'telephone', 'indian_phone', 'error', regexp_full_match(telephone, '{RULES["indian_phone"].pattern}') FROM v
UNION ALL SELECT packet_id, 'ifsc', 'ifsc_format', 'error', regexp_full_match(ifsc, '{RULES["ifsc_format"].pattern}') FROM v
UNION ALL SELECT packet_id, 'account_number', 'account_number_format', 'error', regexp_full_match(account_number, '[0-9]*') AND length(account_number) BETWEEN 9 AND 18 FROM v"""
STATUS = f"""j AS MATERIALIZED ({JUDGED}),
st AS MATERIALIZED (SELECT packet_id, f, CASE WHEN bool_or(NOT ok AND s = 'error') THEN 'invalid' WHEN bool_or(NOT ok AND s = 'warning') THEN 'warning' ELSE 'valid' END AS status,
  CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_failed FROM j WHERE ok IS NOT NULL GROUP BY packet_id, f)"""
RULED = ["vendor_name", "gst_number", "pan", "pin_code", "state", "country", "email", "telephone", "ifsc", "account_number"]
LONG = (
    "lr AS MATERIALIZED (SELECT l.packet_id, l.f, l.value, CASE WHEN coalesce(l.value, '') = '' THEN 'missing' ELSE coalesce(st.status, 'not_validated') END AS status, CASE WHEN l.packet_id % 3 = 0 THEN 0.5 ELSE 0.9 END AS confidence, "
    "l.f = 'state' AND l.packet_id % 4 = 0 AS derived FROM (" + " UNION ALL ".join(f"SELECT packet_id, '{f}' AS f, {f} AS value FROM v" for f in RULED) + ") l LEFT JOIN st USING (packet_id, f)), "
    "ld AS MATERIALIZED (SELECT packet_id, f, derived, CASE WHEN f = 'country' AND coalesce(value, '') = '' THEN 1.0 ELSE confidence END AS confidence, "
    "CASE WHEN f = 'country' AND (coalesce(value, '') = '' OR status = 'invalid') THEN 'India' ELSE value END AS value, "
    "CASE WHEN f = 'country' AND (coalesce(value, '') = '' OR status = 'invalid') THEN 'valid' ELSE status END AS status, "
    "f = 'country' AND (coalesce(value, '') = '' OR status = 'invalid') AS defaulted FROM lr)"
)

CAND = f"c AS MATERIALIZED ({CANDIDATE_SQL})"
SCORED = CAND + """,
s0 AS (SELECT *, 0.0 + 0.45 * label_similarity + 0.15 * proximity + 0.30 * (CASE WHEN has_pattern AND matched THEN 1.0 WHEN NOT has_pattern THEN 0.5 ELSE 0.0 END) + 0.10 * ocr_confidence
    + CASE kind WHEN 'inline' THEN 0.30 WHEN 'adjacent_same_line' THEN 0.18 WHEN 'adjacent' THEN 0.0 ELSE -0.10 END
    + CASE WHEN expected_doc IS NULL THEN 0.0 WHEN expected_doc THEN 0.05 ELSE -0.05 END AS s,
    label_like AND kind <> 'inline' AND NOT matched AS lk, is_text AND length(value) < 3 AS sh
  FROM c WHERE value <> '' AND (NOT has_pattern OR matched)),
s1 AS MATERIALIZED (SELECT *, least(1.0, greatest(0.0, CAST(s AS DOUBLE) * CASE WHEN lk THEN 0.55 ELSE 1.0 END * CASE WHEN "foreign" THEN 0.40 ELSE 1.0 END * CASE WHEN sh THEN 0.5 ELSE 1.0 END)) AS score FROM s0),
s2 AS MATERIALIZED (SELECT * REPLACE (CASE status WHEN 'invalid' THEN score * 0.35 WHEN 'warning' THEN score * 0.75 WHEN 'valid' THEN least(1.0, score + 0.10) ELSE score END AS score) FROM s1),
s3 AS MATERIALIZED (SELECT * FROM (SELECT *, field = 'vendor_name' AND value = 'Micro' AS junk FROM s2)
  QUALIFY NOT junk OR sum(CASE WHEN junk THEN 0 ELSE 1 END) OVER (PARTITION BY packet_id, field) = 0)"""
CHOSEN = SCORED + """,
r1 AS (SELECT *, row_number() OVER (PARTITION BY packet_id, field ORDER BY score DESC, cand_ord) AS rk,
    coalesce(expected_doc, false) OR NOT bool_or(coalesce(expected_doc, false)) OVER (PARTITION BY packet_id, field) AS allowed FROM s3),
r2 AS (SELECT *, max(CASE WHEN allowed THEN score END) OVER (PARTITION BY packet_id, field) AS best FROM r1),
r3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY packet_id, field ORDER BY CASE WHEN allowed AND best - score <= 0.05 THEN 0 ELSE 1 END,
    CASE doc_type WHEN 'gst_certificate' THEN 1 WHEN 'udyam_certificate' THEN 2 ELSE 3 END,
    CASE kind WHEN 'inline' THEN 0 WHEN 'pattern_only' THEN 2 ELSE 1 END, score DESC, cand_ord) AS turn FROM r2)"""

GRID = """g AS MATERIALIZED (SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey % 4 AS page, s_suppkey * 8 + n AS span_id, n,
  CAST((s_suppkey * 7 + n * 3) % 40 * 10 AS DOUBLE) AS x1, CAST((s_suppkey * 5 + n * 11) % 50 * 10 AS DOUBLE) AS y1,
  CAST((s_suppkey * 7 + n * 3) % 40 * 10 + 30 + n AS DOUBLE) AS x2, CAST((s_suppkey * 5 + n * 11) % 50 * 10 + 8 AS DOUBLE) AS y2, CAST(8 AS DOUBLE) AS u
  FROM supplier, (SELECT unnest(range(8)) AS n))"""


def shared(lo1: str, hi1: str, lo2: str, hi2: str) -> str:
    return f"CASE WHEN least({hi1} - {lo1}, {hi2} - {lo2}) > 0 THEN greatest(0.0, least({hi1}, {hi2}) - greatest({lo1}, {lo2})) / least({hi1} - {lo1}, {hi2} - {lo2}) ELSE 0 END"


CUSTOMERS = "cr AS MATERIALIZED (SELECT c_custkey AS id, c_name AS customer_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'G' || CAST(c_custkey % 1000 AS VARCHAR) END AS gst, 'U' || CAST(c_custkey AS VARCHAR) AS udyam, c_mktsegment AS city FROM customer)"

TRUTH_FIELDS = ("vendor_name", "pan", "pin_code", "state", "city", "address_1", "address_2")


def truth_norm(x: str, field: str) -> str:
    t = strip(f"coalesce({x}, '')")
    t = rf"regexp_replace({t}, '^([0-9]+)\.0$', '\1')"
    if field in ("pan", "pin_code"):
        return f"replace(upper({t}), ' ', '')"
    spaced = rf"regexp_replace({t}, '[^\w\s]', ' ', 'g')"
    collapsed = rf"regexp_replace({spaced}, '\s+', ' ', 'g')"
    return f"lower({strip(collapsed)})"


TRUTH = "t AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT packet_id, '{f}' AS f, coalesce({f}, '') AS v, packet_id + {i} AS k, CASE WHEN (packet_id + {i}) % 7 = 0 THEN NULL WHEN (packet_id + {i}) % 5 = 0 THEN coalesce({f}, '') || 'x' "
    f"WHEN (packet_id + {i}) % 4 = 0 THEN '  ' || lower(coalesce({f}, '')) || '. ' ELSE coalesce({f}, '') END AS g FROM v" for i, f in enumerate(TRUTH_FIELDS)
) + "), o AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT packet_id, f, CASE WHEN k % 6 = 0 AND trim(coalesce(g, '')) <> '' THEN 'hallucinated' WHEN k % 6 = 0 THEN 'correctly_absent' WHEN trim(coalesce(g, '')) = '' THEN 'missed' "
    f"WHEN {truth_norm('v', f)} = {truth_norm('g', f)} THEN 'correct' ELSE 'wrong' END AS outcome FROM t WHERE f = '{f}'" for f in TRUTH_FIELDS
) + ")"

ERP = {"Name": "vendor_name", "Address": "address_1", "City": "city", "County": "state", "Country_Region_Code": "country", "Post_Code": "pin_code", "Phone_No": "telephone", "E_Mail": "email", "PAN_Number": "pan", "GST_Number": "gst_number"}
ERP_FIELDS = {k: f"nullif({strip(f'coalesce({c}, {chr(39) * 2})')}, '')" for k, c in ERP.items()} | {
    "Address_2": "nullif(array_to_string(list_filter([nullif(trim(coalesce(address_2, '')), ''), nullif(trim(coalesce(address_3, '')), '')], lambda q: q IS NOT NULL), ', '), '')"
}

PHRASES = "CASE squash " + " ".join(f"WHEN '{p.replace(' ', '')}' THEN '{p}'" for p in LEGAL_PHRASES) + " ELSE x END"
SPELLING = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIX_SPELLING.items()) + " END"

def stripped(x: str) -> str:
    """Without white space at both ends."""
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


WHITE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE_SQL: dict[str, str] = {
    "email_extract": f"WITH {EMAILS} SELECT doc_id, pos, email FROM em WHERE regexp_full_match(email, '{EMAIL}')",
    "account_number_scan": "SELECT doc_id, a AS account_number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS a FROM documents) WHERE regexp_full_match(a, '[0-9]{9,18}') GROUP BY ALL",
    "website_derive": f"""WITH {EMAILS}, f AS (SELECT doc_id, min_by(email, pos) AS email FROM em WHERE regexp_full_match(email, '{EMAIL}') GROUP BY doc_id),
      w AS (SELECT d.doc_id, email, CASE WHEN contains({DOMAIN}, '.') AND {DOMAIN} NOT IN ({values(FREE_MAIL)}) THEN 'www.' || {DOMAIN} END AS website FROM documents d LEFT JOIN f USING (doc_id))
      SELECT *, CASE WHEN email IS NULL THEN 'missing_required_field' WHEN website IS NOT NULL THEN 'value_derived_not_printed' END AS flag FROM w""",
    "normalize_chain": rf"""SELECT p_partkey, {strip(PX)} AS stripped, {strip(rf"regexp_replace({PX}, '\s+', ' ', 'g')")} AS collapsed, upper(regexp_replace({PX}, '\s+', '', 'g')) AS squashed,
      array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS titled, regexp_replace({PX}, '\D', '', 'g') AS digits,
      '9' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS phone, lower({strip(rf"regexp_replace(regexp_replace({strip(PX)}, '^[\s\-:.|*]+|[\s\-:.|*]+$', '', 'g'), '\s+', ' ', 'g')")}) AS label,
      {strip(rf"regexp_replace({PX}, '^[\s:\-–—=|.,)#]+', '')")} AS bare, regexp_replace(lower({PX}), '[^a-z0-9]', '', 'g') AS key FROM part""",
    "ifsc_repair": f"""WITH {V}, x AS (SELECT packet_id, ifsc, CASE WHEN length(ifsc) = 11 THEN translate(substr(upper(ifsc), 1, 4), '015826', 'OISBZG') || '0' || substr(upper(ifsc), 6, 6) ELSE ifsc END AS fixed FROM v)
      SELECT *, regexp_full_match(fixed, '{RULES["ifsc_format"].pattern}') AS ok FROM x""",
    "width_fit": "SELECT doc_id, " + ", ".join(f"{fit('coalesce(text, ' + chr(39) * 2 + ')', w)} AS w{w}" for w in (20, 30, 50, 80)) + " FROM documents",
    "doc_classify": """WITH s AS (SELECT doc_id, lang || '_' || source AS n, lower(coalesce(text, '')) AS x FROM documents), k AS (SELECT doc_id,
        [contains(n, 'en_')::INT * 1.0 + 2.0 * (contains(x, 'the ')::INT + contains(x, 'licensed under')::INT + contains(x, ' and ')::INT), contains(n, 'fr_')::INT * 1.0 + 2.0 * (contains(x, 'les ')::INT + contains(x, 'éau')::INT),
         contains(n, 'de_')::INT * 1.0 + 2.0 * (contains(x, 'der ')::INT + contains(x, 'und ')::INT + contains(x, 'nicht')::INT), contains(n, 'es_')::INT * 1.0 + 2.0 * (contains(x, 'los ')::INT + contains(x, 'ción')::INT + contains(x, 'para ')::INT)] AS l FROM s)
      SELECT doc_id, CASE WHEN list_max(l) >= 1 THEN ['english', 'french', 'german', 'spanish'][list_position(l, list_max(l))] ELSE 'other' END AS doc_type, CAST(CASE WHEN list_max(l) >= 1 THEN list_max(l) ELSE 0 END AS DOUBLE) AS type_score FROM k""",
    "validator_suite": f"WITH {V}, {STATUS} SELECT packet_id, f AS field_name, status, n_failed FROM st",
    "validator_counts": f"WITH {V}, {STATUS} SELECT r AS validator, count(*) AS n, count(*) FILTER (WHERE ok) AS passed FROM j WHERE ok IS NOT NULL GROUP BY r",
    "pin_state_check": f"""WITH {V}, d AS (SELECT pin_code AS pin, CASE WHEN packet_id % 5 = 0 OR packet_id % 2 = 0 THEN 'west bengal' ELSE 'kerala' END AS s FROM v WHERE packet_id % 4 <> 3 AND packet_id % 6 <> 0)
      SELECT packet_id, 'state' AS field_name, lower(trim(state)) = s AS ok FROM v JOIN d ON pin_code = pin WHERE regexp_full_match(pin_code, '[0-9]{{6}}')""",
    "gstin_pan_fallback": f"""WITH {V}, x AS (SELECT *, CASE WHEN regexp_full_match(coalesce(gst_number, ''), '{RULES["gstin_format"].pattern}') THEN gst_number ELSE '' END AS g, CASE WHEN regexp_full_match(pan, '{RULES["pan_format"].pattern}') THEN pan ELSE '' END AS p FROM v),
      y AS (SELECT *, p = '' AND regexp_full_match(substr(g, 3, 10), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS fb FROM x)
      SELECT packet_id, g AS gst_registration_number, CASE WHEN fb THEN substr(g, 3, 10) ELSE p END AS pan_number, fb AS pan_from_gstin, CASE WHEN regexp_full_match(pin_code, '[1-9][0-9]{{5}}') THEN pin_code ELSE '' END AS pin_code,
      CASE WHEN regexp_full_match(ifsc, '{RULES["ifsc_format"].pattern}') THEN ifsc ELSE '' END AS ifsc,
      array_to_string(list_filter([nullif(trim(coalesce(address_1, '')), ''), nullif(trim(coalesce(address_2, '')), ''), nullif(trim(coalesce(address_3, '')), '')], lambda q: q IS NOT NULL), ', ') AS billing_address FROM y""",
    "synthetic_layout": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: {stripped('s')}), lambda s: s <> '') AS l FROM documents), r AS (SELECT doc_id, i - 1 AS row, l[i] AS t FROM l, unnest(range(1, len(l) + 1)) AS u(i))
      SELECT doc_id, CAST(row // 47 + 1 AS INT) AS page, CAST(row AS INT) AS line_no, CAST(length(t) AS INT) AS chars, 150 AS x1, CAST(150 + (row % 47) * 44 AS INT) AS y1, CAST(150 + least(length(t) * 15, 1354) AS INT) AS x2, CAST(194 + (row % 47) * 44 AS INT) AS y2 FROM r""",
    "neighbours": f"""WITH {GRID}, p AS (SELECT a.doc_id, b.span_id, {shared('a.y1', 'a.y2', 'b.y1', 'b.y2')} AS vo, {shared('a.x1', 'a.x2', 'b.x1', 'b.x2')} AS ho, a.u, a.x1, a.x2, a.y1, a.y2, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2
        FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.page = b.page AND a.span_id <> b.span_id WHERE a.n = 0),
      h AS (SELECT *, CASE WHEN vo >= 0.3 AND bx1 >= x2 - 0.3 * u AND greatest(0.0, bx1 - x2) <= 6.0 * u THEN 'right' WHEN by1 >= y2 - 0.3 * u AND (ho >= 0.15 OR abs(x1 - bx1) <= 2 * u) AND greatest(0.0, by1 - y2) <= 6.0 * u THEN 'below'
        WHEN vo >= 0.3 AND bx2 <= x1 + 0.3 * u AND greatest(0.0, x1 - bx2) <= 6.0 * u THEN 'left' WHEN by2 <= y1 + 0.3 * u AND (ho >= 0.15 OR abs(x1 - bx1) <= 2 * u) AND greatest(0.0, y1 - by2) <= 6.0 * u THEN 'above' END AS direction FROM p)
      SELECT doc_id, direction, count(*) AS n, sum(round(greatest(0.0, CASE direction WHEN 'right' THEN bx1 - x2 WHEN 'below' THEN by1 - y2 WHEN 'left' THEN x1 - bx2 ELSE y1 - by2 END) / u / 6.0, 6)) AS ratios, min(span_id) AS first_span FROM h WHERE direction IS NOT NULL GROUP BY doc_id, direction""",
    "char_sessionize": """WITH c AS (SELECT s_suppkey AS doc_id, s_name || chr(10) || 'x' || CAST(CAST(trunc(s_acctbal) AS INT) AS VARCHAR) AS t FROM supplier),
      k AS (SELECT doc_id, i - 1 AS i, substr(t, i, 1) AS ch, CAST((i - 1) * 5 + CASE WHEN i > 8 THEN 20 ELSE 0 END AS DOUBLE) AS x1 FROM c, unnest(range(1, length(t) + 1)) AS u(i)),
      m AS (SELECT *, CASE WHEN lag(ch) OVER w IS NULL OR ch = chr(10) OR lag(ch) OVER w = chr(10) OR x1 - lag(x1 + 4) OVER w > 10 THEN 1 ELSE 0 END AS nw FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      s AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS sn FROM m)
      SELECT doc_id, CAST(sn AS BIGINT) AS session_no, string_agg(ch, '' ORDER BY i) AS text, min(x1) AS x1, max(x1 + 4) AS x2 FROM s WHERE ch <> chr(10) GROUP BY doc_id, sn""",
    "page_trust": """WITH p AS (SELECT length(trim(coalesce(text, ''), ' ')) AS n, least(doc_id % 12 / 10.0, 1.0) AS c FROM documents), r AS (SELECT CASE WHEN n < 40 THEN 'no_text_layer' WHEN c >= 0.5 THEN 'scanned_page(image_coverage=' || CAST(CAST(round(c * 100) AS INT) AS VARCHAR) || '%)' END AS r FROM p)
      SELECT CASE WHEN r IS NULL THEN 'pdf_text' ELSE 'ocr' END AS method, coalesce(r, 'none') AS reason, count(*) AS n FROM r GROUP BY ALL""",
    "candidate_score": f"WITH {SCORED} SELECT packet_id, cand_ord, round(score, 9) AS score, array_to_string(list_filter([CASE WHEN lk THEN 'label_like' END, CASE WHEN \"foreign\" THEN 'foreign_pattern' END, CASE WHEN sh THEN 'too_short' END], lambda q: q IS NOT NULL), ',') AS notes FROM s1",
    "validation_bias": f"WITH {SCORED} SELECT packet_id, cand_ord, round(score, 9) AS score FROM s2",
    "choose_best": f"""WITH {CHOSEN} SELECT packet_id, field AS field_name, max(value) FILTER (WHERE turn = 1) AS value, round(max(score) FILTER (WHERE turn = 1), 9) AS score, max(doc_type) FILTER (WHERE turn = 1) AS doc_type, max(kind) FILTER (WHERE turn = 1) AS kind,
      coalesce(array_to_string((list(value ORDER BY rk) FILTER (WHERE rk <= 6 AND turn > 1))[1:5], '|'), '') AS alternatives FROM r3 GROUP BY packet_id, field""",
    "pattern_only_anti": f"WITH {CAND} SELECT field AS field_name, packet_id * 12 + cand_ord AS span_id, value FROM c WHERE kind = 'pattern_only'",
    "canonical_pivot": f"WITH {V}, {STATUS}, {LONG} SELECT packet_id, " + ", ".join(f"nullif(max(value) FILTER (WHERE f = '{f}'), '') AS {f}" for f in RULED) + " FROM ld GROUP BY packet_id",
    "packet_summary": f"""WITH {V}, {STATUS}, {LONG} SELECT packet_id, count(*) AS total, count(*) FILTER (WHERE coalesce(value, '') <> '') AS filled, count(*) FILTER (WHERE coalesce(value, '') = '') AS empty, count(*) FILTER (WHERE status = 'valid') AS valid,
      CAST(round_even(100.0 * count(*) FILTER (WHERE coalesce(value, '') <> '') / count(*), 0) AS DOUBLE) AS fill_rate FROM ld GROUP BY packet_id""",
    "review_flags": f"""WITH {V}, {STATUS}, {LONG}, b AS (SELECT *, coalesce(value, '') = '' AS e FROM ld)
      SELECT packet_id, f AS field_name, 'value_derived_not_printed' AS reason, 1 AS stage FROM b WHERE derived AND NOT e
      UNION ALL SELECT packet_id, f, 'missing_required_field', 2 FROM b WHERE f IN ('vendor_name', 'gst_number', 'pan') AND e
      UNION ALL SELECT packet_id, f, CASE status WHEN 'invalid' THEN 'failed_validation' ELSE 'validation_warning' END, 3 FROM b WHERE status IN ('invalid', 'warning') AND NOT e
      UNION ALL SELECT packet_id, f, 'low_confidence', 4 FROM b WHERE NOT e AND NOT defaulted AND confidence < 0.60""",
    "lookup_state_city": """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' Nation_' || (s_suppkey % 30) WHEN s_suppkey % 3 = 1 THEN 'ST-' || (s_suppkey % 30) ELSE 'Asia' END AS token FROM supplier), k AS (SELECT *, regexp_replace(lower(token), '[^a-z0-9]', '', 'g') AS key FROM s)
      SELECT k.s_suppkey, k.token, coalesce(n.n_name, a.n_name) AS state, r.r_name IS NOT NULL AS is_city FROM k LEFT JOIN nation n ON regexp_replace(lower(n.n_name), '[^a-z0-9]', '', 'g') = k.key
      LEFT JOIN nation a ON 'st' || a.n_nationkey = k.key LEFT JOIN region r ON regexp_replace(lower(r.r_name), '[^a-z0-9]', '', 'g') = k.key""",
    "records_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 50",
    "find_duplicates": f"""WITH {CUSTOMERS}, i AS (SELECT id, gst, CASE WHEN id % 2 = 0 THEN 'U' || CAST(id + 1 AS VARCHAR) END AS udyam FROM cr),
      x AS (SELECT i.id, (SELECT min(c.id) FROM cr c WHERE c.gst = i.gst AND c.id <> i.id) AS g, (SELECT min(c.id) FROM cr c WHERE c.udyam = i.udyam AND c.id <> i.id) AS u FROM i)
      SELECT id, coalesce(g, u) AS existing_id, CASE WHEN g IS NOT NULL THEN 'gst' WHEN u IS NOT NULL THEN 'udyam' END AS clash FROM x""",
    "unique_violations": f"WITH {CUSTOMERS} SELECT gst, count(*) AS n FROM cr WHERE gst IS NOT NULL GROUP BY gst HAVING count(*) > 1",
    "patch_records": f"WITH {CUSTOMERS} SELECT id, customer_name, CASE WHEN id % 4 = 0 THEN NULL ELSE gst END AS gst, udyam, CASE WHEN id % 4 = 0 THEN 'New' || id ELSE city END AS city FROM cr",
    "delete_records": f"WITH {CUSTOMERS} SELECT * FROM cr WHERE id % 5 <> 0",
    "upsert_records": f"WITH {CUSTOMERS}, i AS (SELECT * REPLACE (CASE WHEN id % 12 = 0 THEN id ELSE -id END AS id, 'UPSERTED' AS city) FROM cr WHERE id % 6 = 0) SELECT * FROM cr WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT * FROM i",
    "mark_pushed": f"""WITH {CUSTOMERS}, x AS (SELECT CASE WHEN id % 3 = 0 THEN 'pushed' ELSE 'not_pushed' END AS b, CASE WHEN id % 2 <> 0 THEN 'untouched' WHEN id % 3 = 0 THEN 'conflict' ELSE 'ok' END AS outcome FROM cr)
      SELECT CASE WHEN outcome = 'ok' THEN 'pushed' ELSE b END AS bc_status, outcome, count(*) AS n FROM x GROUP BY ALL""",
    "erp_payload": f"WITH {V} SELECT packet_id AS id, " + ", ".join(f"{fit(ERP_FIELDS[k], ERP_WIDTHS[k]) if k in ERP_WIDTHS else ERP_FIELDS[k]} AS {k}" for k in ("Name", "Address", "Address_2", "City", "County", "Country_Region_Code", "Post_Code", "Phone_No", "E_Mail", "PAN_Number", "GST_Number"))
    + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN length({ERP_FIELDS[k]}) > {ERP_WIDTHS[k]} THEN '{k}' END" for k in ("Name", "Address", "City", "County", "Country_Region_Code", "Post_Code", "Phone_No", "E_Mail", "PAN_Number", "GST_Number", "Address_2") if k in ERP_WIDTHS)
    + "], lambda q: q IS NOT NULL), ',') AS truncated FROM v",
    "verify_cells": f"""WITH {V}, e AS (SELECT packet_id, 'B2' AS cell, coalesce(nullif(vendor_name, ''), '-') AS value FROM v UNION ALL SELECT packet_id, 'B3', coalesce(nullif(pan, ''), 'N/A') FROM v UNION ALL SELECT packet_id, 'C1', coalesce(nullif(account_number, ''), '') FROM v),
      a AS (SELECT *, CASE WHEN packet_id % 15 = 1 THEN NULL WHEN packet_id % 10 = 0 THEN 'tampered' WHEN cell = 'C1' THEN value || '.0' ELSE ' ' || upper(value) END AS actual FROM e),
      c AS (SELECT packet_id, lower(trim(value)) = lower(regexp_replace(trim(coalesce(actual, '')), '^([0-9]+)\\.0$', '\\1')) AS ok FROM a)
      SELECT packet_id, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate FROM c GROUP BY packet_id""",
    "eval_outcomes": f"""WITH {V}, {TRUTH}, n AS (SELECT f, count(*) FILTER (WHERE outcome = 'wrong') AS wrong, count(*) FILTER (WHERE outcome = 'hallucinated') AS hallucinated, count(*) FILTER (WHERE outcome = 'missed') AS missed, count(*) FILTER (WHERE outcome = 'correct') AS correct,
        count(*) FILTER (WHERE outcome = 'correctly_absent') AS correctly_absent, count(*) AS total FROM o GROUP BY f)
      SELECT f AS field_name, wrong, hallucinated, missed, correct, correctly_absent, total, round_even(100.0 * correct / nullif(correct + wrong + missed, 0), 1) AS recall, round_even(100.0 * correct / nullif(correct + wrong + hallucinated, 0), 1) AS precision,
      round_even(100.0 * (correct + correctly_absent) / total, 1) AS accuracy FROM n""",
    "address_block": f"""WITH {V}, {TRUTH} SELECT packet_id, count(*) AS fields, count(*) FILTER (WHERE outcome IN ('wrong', 'missed', 'hallucinated')) = 0 AS exact,
      round_even(100.0 * count(*) FILTER (WHERE outcome = 'correct') / nullif(count(*) - count(*) FILTER (WHERE outcome = 'correctly_absent'), 0), 1) AS field_accuracy FROM o WHERE f IN ('pin_code', 'state', 'city', 'address_1', 'address_2') GROUP BY packet_id""",
    "gap_groups": """WITH f AS (SELECT s_suppkey AS packet_id, i, (s_suppkey * 3 + i * i) % 6 AS level, (s_suppkey + i) % 4 AS tier, (s_suppkey + i) % 5 = 0 AS inj FROM supplier, (SELECT unnest(range(6)) AS i)),
      g AS (SELECT *, greatest(0, CASE WHEN level - lag(level) OVER w = 1 THEN 0.5 WHEN level - lag(level) OVER w > 1 THEN 0.6 WHEN level < lag(level) OVER w THEN CASE WHEN level <= 2 AND lag(level) OVER w <= 2 THEN 0.2 ELSE 0.4 END ELSE 0.0 END
        + CASE WHEN tier <> lag(tier) OVER w THEN 0.2 ELSE 0.0 END - CASE WHEN inj THEN 0.15 ELSE 0.0 END) AS gap, lag(i) OVER w AS pi FROM f WINDOW w AS (PARTITION BY packet_id ORDER BY i)),
      h AS (SELECT *, sum(CASE WHEN pi IS NOT NULL AND gap >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY packet_id ORDER BY i) AS g FROM g)
      SELECT packet_id, CAST(g AS BIGINT) AS g, count(*) AS n, CAST(min(i) AS INT) AS first_i, max(level) AS top_level FROM h GROUP BY packet_id, g""",
}
ORACLE_SQL["type_counts"] = f"SELECT doc_type, count(*) AS n, max(type_score) AS best FROM ({ORACLE_SQL['doc_classify']}) GROUP BY doc_type"

# The kinds of the pieces are written down by hand, not computed from the key words.
PIECE_KINDS = """VALUES (0, 'Plot 7', 'premises_unit', 1, 100), (1, '3RD FLOOR', 'premises_unit', 1, 100), (2, 'Block B', 'structural', 1, 100), (3, 'Sunrise Building', 'building_name', 2, 100),
  (4, 'Orion Tech Park', 'estate_zone', 2, 100), (5, 'MG Road', 'thoroughfare', 3, 100), (6, 'Near Lake Road', 'landmark', 3, 50), (7, 'Gandhi Nagar', 'locality', 4, 100), (8, 'Andul', 'unknown', 4, 55),
  (9, 'Village Rampur', 'village_po', 5, 100), (10, 'GREENFIELDTOWER', 'building_name', 2, 75), (11, '#12', 'premises_unit', 1, 80), (12, 'B-12', 'premises_unit', 1, 70), (13, 'Building D', 'structural', 1, 80)"""
ORACLE_SQL["address_segment"] = f"""WITH cls(j, t, tier, level, conf) AS ({PIECE_KINDS}),
  f AS (SELECT s_suppkey AS packet_id, i, t, tier, level, conf FROM supplier, (SELECT unnest(range(7)) AS i), cls
    WHERE i < CASE WHEN s_suppkey % 5 = 0 THEN 7 ELSE 2 + s_suppkey % 6 END AND j = CASE WHEN s_suppkey % 5 = 0 AND i >= 2 THEN 7 + (s_suppkey + i) % 2 ELSE (s_suppkey * (i + 2) + 3 * i * i) % 14 END),
  g AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL THEN -1 ELSE CASE WHEN level - lag(level) OVER w = 1 THEN 50 WHEN level - lag(level) OVER w > 1 THEN 60
      WHEN level < lag(level) OVER w THEN CASE WHEN level <= 2 AND lag(level) OVER w <= 2 THEN 20 ELSE 40 END ELSE 0 END + CASE WHEN tier <> lag(tier) OVER w THEN 20 ELSE 0 END END AS gap FROM f WINDOW w AS (PARTITION BY packet_id ORDER BY i)),
  a AS (SELECT packet_id, count(*) AS n, sum(conf) AS total, max(CASE WHEN gap >= 50 THEN i END) AS cut, coalesce(max(CASE WHEN level < 4 THEN i END), -1) AS narrow FROM g GROUP BY packet_id),
  b AS (SELECT *, CASE WHEN total >= 70 * n THEN 'high' WHEN total >= 45 * n THEN 'medium' ELSE 'low' END AS lv FROM a),
  c AS (SELECT *, lv <> 'low' AND cut IS NOT NULL AND n - greatest(cut, narrow + 1) >= 4 AS peel FROM b),
  d AS (SELECT *, CASE WHEN peel AND lv = 'high' THEN 'medium' ELSE lv END AS line_confidence FROM c),
  k AS (SELECT g.packet_id, g.i, row_number() OVER (PARTITION BY g.packet_id ORDER BY CASE WHEN peel AND g.i = n - 1 THEN 1 ELSE 0 END DESC, gap DESC, g.i DESC) AS r, CASE line_confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS room
    FROM g JOIN d USING (packet_id) WHERE gap >= 50 OR (peel AND g.i = n - 1)),
  o AS (SELECT g.packet_id, g.i, g.t, (SELECT count(*) FROM k WHERE k.packet_id = g.packet_id AND k.r <= k.room AND k.i <= g.i) AS line FROM g),
  l AS (SELECT packet_id, line, string_agg(t, ', ' ORDER BY i) AS txt FROM o GROUP BY packet_id, line)
  SELECT packet_id, coalesce(max(CASE WHEN line = 0 THEN txt END), '') AS address_1, coalesce(max(CASE WHEN line = 1 THEN txt END), '') AS address_2, coalesce(max(CASE WHEN line = 2 THEN txt END), '') AS address_3,
    coalesce(max(CASE WHEN line = 3 THEN txt END), '') AS address_4, any_value(line_confidence) AS line_confidence, round(any_value(total) / (100.0 * any_value(n)), 3) AS line_score FROM l JOIN d USING (packet_id) GROUP BY packet_id"""
# Row by row, with the lists of what is taken so far.
ORACLE_SQL["record_insert"] = f"""WITH RECURSIVE {CUSTOMERS}, st AS (SELECT * FROM cr WHERE id % 2 = 0),
  i AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS nm, c_custkey % 30 AS ow, CASE WHEN c_custkey % 5 = 0 THEN 'G' || (c_custkey % 1000) ELSE 'N' || (c_custkey // 3) END AS gst, CASE WHEN c_custkey % 4 <> 0 THEN 'N' || (c_custkey // 2) END AS udyam FROM customer),
  x AS (SELECT *, (SELECT min(id) FROM st WHERE st.gst = i.gst) AS g, (SELECT min(id) FROM st WHERE st.udyam = i.udyam) AS u FROM i),
  y AS (SELECT *, CASE WHEN coalesce(nm, '') = '' THEN 'missing_required' WHEN ow NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown_owner' WHEN g IS NOT NULL OR u IS NOT NULL THEN 'conflict' END AS oc FROM x),
  p AS (SELECT row_number() OVER (ORDER BY row_id) AS i, row_id, gst, udyam FROM y WHERE oc IS NULL),
  r(i, row_id, gs, us, clash) AS (SELECT 0, CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR)
    UNION ALL SELECT p.i, p.row_id, CASE WHEN c IS NULL AND p.gst IS NOT NULL THEN list_append(gs, p.gst) ELSE gs END, CASE WHEN c IS NULL AND p.udyam IS NOT NULL THEN list_append(us, p.udyam) ELSE us END, c
    FROM r JOIN p ON p.i = r.i + 1, LATERAL (SELECT CASE WHEN list_contains(gs, p.gst) THEN 'gst' WHEN list_contains(us, p.udyam) THEN 'udyam' END AS c) AS l)
  SELECT y.row_id, coalesce(oc, CASE WHEN r.clash IS NULL THEN 'accepted' ELSE 'conflict' END) AS outcome,
    CASE WHEN oc = 'conflict' THEN CASE WHEN g IS NOT NULL THEN 'gst' ELSE 'udyam' END WHEN oc IS NULL THEN r.clash END AS clash, CASE WHEN oc = 'conflict' THEN coalesce(g, u) END AS existing_id
    FROM y LEFT JOIN r USING (row_id)"""
BILLING = "concat_ws(', ', nullif(address_1, ''), nullif(address_2, ''), nullif(address_3, ''))"
ORACLE_SQL["payloads"] = f"""WITH {V} SELECT packet_id, coalesce(vendor_name, '') AS vendor_name, coalesce(address_2, '') AS address_2, '' AS address_4, coalesce(telephone, '') AS telephone_1, '' AS telephone_2, '' AS tan_no,
  coalesce(gst_number, '') AS gst_no, coalesce(ifsc, '') AS ifsc_swift_code, coalesce(vendor_name, '') AS company_name, {BILLING} AS billing_address, coalesce(pin_code, '') AS zip_code, coalesce(pan, '') AS pan_number,
  coalesce(telephone, '') AS phone_number, '' AS region, 'Services' AS type FROM v"""
ORACLE_SQL["customer_form"] = f"""WITH {V}, w AS (SELECT *, regexp_full_match(coalesce(gst_number, ''), '{RULES["gstin_format"].pattern}') AS gok, regexp_full_match(coalesce(pan, ''), '{RULES["pan_format"].pattern}') AS pok,
    CASE WHEN packet_id % 3 = 0 THEN '' ELSE city END AS c, CASE WHEN regexp_full_match(pin_code, '{RULES["pin_format"].pattern}') THEN pin_code ELSE '' END AS z FROM v),
  y AS (SELECT *, CASE WHEN pok THEN pan WHEN gok AND regexp_full_match(substr(gst_number, 3, 10), '{RULES["pan_format"].pattern}') THEN substr(gst_number, 3, 10) ELSE '' END AS pn, NOT pok AND gok AND regexp_full_match(substr(gst_number, 3, 10), '{RULES["pan_format"].pattern}') AS der,
    packet_id % 2 = 0 AND (c = '' OR z = '' OR coalesce(state, '') = '') AS go FROM w)
  SELECT packet_id, vendor_name AS company_name, CASE WHEN go THEN 'Rest ' || packet_id ELSE {BILLING} END AS billing_address, CASE WHEN go AND c = '' THEN 'Found City' ELSE c END AS city, state, CASE WHEN go AND z = '' THEN '403001' ELSE z END AS zip_code,
    pn AS pan_number, 'Services' AS type, CASE WHEN regexp_full_match(ifsc, '{RULES["ifsc_format"].pattern}') THEN ifsc ELSE '' END AS ifsc_code,
    concat_ws(',', CASE WHEN packet_id % 4 = 0 THEN 'company_name,city' END, CASE WHEN der THEN 'pan_number' END, CASE WHEN go AND c = '' AND packet_id % 4 <> 0 THEN 'city' END, CASE WHEN go AND z = '' THEN 'zip_code' END) AS review FROM y"""
ORACLE_SQL["back_fill"] = f"""WITH {V}, p AS (SELECT packet_id, CASE WHEN packet_id % 7 = 0 THEN 'Main Gate' ELSE address_1 END AS a1, coalesce(address_2, '') AS a2, CASE WHEN packet_id % 2 = 0 THEN '' ELSE city END AS c, CASE WHEN packet_id % 3 <> 0 THEN state ELSE '' END AS s, pin_code,
    packet_id % 4 <> 0 AND packet_id % 9 <> 0 AS solid FROM v),
  q AS (SELECT *, packet_id % 8 <> 5 AND packet_id % 7 <> 0 AND NOT (c <> '' AND s <> '' AND solid) AS go FROM p)
  SELECT packet_id, CASE WHEN go THEN 'Line One' ELSE a1 END AS address_1, CASE WHEN go THEN 'Line Two ' || packet_id ELSE a2 END AS address_2, CASE WHEN go AND packet_id % 5 = 0 THEN 'Line Three' ELSE 'stale' END AS address_3,
    CASE WHEN go AND c = '' THEN 'Pune' ELSE c END AS city, CASE WHEN go AND s = '' THEN 'Maharashtra' ELSE s END AS state, CASE WHEN go AND NOT solid AND packet_id % 10 <> 0 THEN '' ELSE pin_code END AS pin_code,
    concat_ws(',', CASE WHEN go THEN 'address_2' END, CASE WHEN go AND packet_id % 5 = 0 THEN 'address_3' END, CASE WHEN go AND c = '' THEN 'city' END, CASE WHEN go AND s = '' THEN 'state' END) AS resolved FROM q"""
ORACLE_SQL["address_eval"] = f"""WITH {V}, r AS (SELECT packet_id AS id, (['high', 'medium', 'low'])[packet_id % 3 + 1] AS confidence, packet_id AS k,
    CASE WHEN packet_id % 4 <> 0 AND packet_id % 7 = 0 THEN 'missed' ELSE 'correct' END AS o1,
    CASE WHEN coalesce(address_2, '') = '' THEN CASE WHEN packet_id % 6 = 0 THEN 'hallucinated' ELSE 'correctly_absent' END WHEN packet_id % 6 = 0 THEN 'wrong' ELSE 'correct' END AS o2, packet_id % 5 <> 0 AS has_city FROM v),
  c AS (SELECT *, o1 = 'missed' OR o2 IN ('hallucinated', 'wrong') AS bad FROM r)
  SELECT confidence, count(*) AS n, count(*) FILTER (WHERE NOT bad) AS right, count(*) FILTER (WHERE (NOT bad AND confidence = 'low' AND has_city) OR (bad AND confidence = 'high')) AS miscalibrated FROM c GROUP BY confidence"""
ORACLE_SQL["sheet_fill"] = f"""WITH {V}, s AS (SELECT unnest(['Main', 'Copy']) AS sheet_name)
  SELECT packet_id, sheet_name, 'B2' AS cell, 'vendor_name' AS field_name, coalesce(nullif(vendor_name, ''), '-') AS cell_value FROM v, s UNION ALL SELECT packet_id, sheet_name, 'B3', 'pan', coalesce(nullif(pan, ''), 'N/A') FROM v, s
  UNION ALL SELECT packet_id, 'Bank', 'C1', 'account_number', coalesce(nullif(account_number, ''), '') FROM v"""

# The right spacing is made from the parts; the query has only the parts run together.
ORACLE_SQL["word_break"] = """WITH p AS (SELECT c_custkey, c_custkey % 6 AS m, c_custkey // 6 AS q FROM customer),
w AS (SELECT *, ['LAKESIDE', 'TALOJA', 'HOSUR', 'SERVICE', 'ELECTRON'][q % 5 + 1] AS place FROM p),
s AS (SELECT c_custkey, CASE m WHEN 0 THEN 'FLAT NO ' || (100 + c_custkey % 900) WHEN 1 THEN 'BLOCK ' || ['A', 'B', 'C', 'D'][q % 4 + 1] || ' SECTOR ' || (10 + c_custkey % 80)
  WHEN 2 THEN place || ' ROAD' WHEN 3 THEN ['MAHALAXMI', 'BOMMANAHALLI', 'RAMWADI', 'GANDHINAGAR'][q % 4 + 1] WHEN 4 THEN '2ND FLOOR WING ' || ['A', 'C', 'E'][q % 3 + 1]
  ELSE 'PLOT NO ' || (10 + c_custkey % 90) || ' ' || place || ' PLAZA' END AS address FROM w)
SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN replace(replace(address, ' ', ''), ['LAKESIDE', 'TALOJA', 'HOSUR', 'SERVICE', 'ELECTRON'][c_custkey // 6 % 5 + 1], '  ' || ['LAKESIDE', 'TALOJA', 'HOSUR', 'SERVICE', 'ELECTRON'][c_custkey // 6 % 5 + 1])
  ELSE replace(address, ' ', '') END AS run_together, address FROM s"""

# The right lines and places are made from the parts, not by the resolver's rules.
ORACLE_SQL["address_lines"] = """SELECT c_custkey AS id,
  CASE c_custkey % 5 WHEN 0 THEN 'FLAT NO ' || (100 + c_custkey % 900) WHEN 1 THEN 'TOWN' || CASE WHEN c_nationkey > 9 THEN ' ' ELSE '' END || c_nationkey || ' ROAD'
    WHEN 2 THEN 'Plot ' || (10 + c_custkey % 90) WHEN 3 THEN 'BLOCK B' ELSE 'POCKET 4, Old House' END AS address_1,
  CASE c_custkey % 5 WHEN 0 THEN 'LAKESIDE ROAD' WHEN 2 THEN 'HOSUR ROAD' WHEN 3 THEN 'SUNRISE PLAZA' ELSE '' END AS address_2,
  CASE c_custkey % 5 WHEN 0 THEN 'SECTOR ' || (10 + c_custkey % 80) WHEN 2 THEN 'GANDHINAGAR' ELSE '' END AS address_3, '' AS address_4,
  CASE c_custkey % 5 WHEN 0 THEN 'New Port ' || c_nationkey WHEN 1 THEN '' WHEN 3 THEN 'District ' || c_nationkey ELSE 'Town' || c_nationkey END AS city,
  CASE WHEN c_custkey % 5 = 4 THEN '' ELSE 'State ' || c_nationkey END AS state, CASE WHEN c_custkey % 5 IN (2, 3) THEN CAST(500000 + c_nationkey AS VARCHAR) ELSE '' END AS pin_code,
  CASE c_custkey % 5 WHEN 0 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS confidence FROM customer"""

# What was printed on the documents, and the reasons that each kind of packet was made to have.
ORACLE_SQL["extract_packets"] = """WITH p AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 6 AS m, ['Kerala', 'Goa', 'Punjab', 'Bihar', 'Gujarat'] AS names FROM supplier)
SELECT k AS packet_id, CASE WHEN m <> 5 THEN 'Acme Tools ' || k END AS vendor_name,
  CASE WHEN m = 1 THEN '99' ELSE lpad(CAST(n + 1 AS VARCHAR), 2, '0') END || 'ABCDE' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || 'F1Z5' AS gst_number,
  'ABCDE' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || 'F' AS pan, 'FLAT NO ' || (100 + k % 900) AS address_1, 'LAKESIDE ROAD' AS address_2, 'SECTOR ' || (10 + k % 80) AS address_3,
  CAST(NULL AS VARCHAR) AS address_4, 'New Port ' || n AS city, names[n % 5 + 1] AS state,
  CASE WHEN m = 0 THEN CAST(500000 + n AS VARCHAR) WHEN m = 3 THEN CAST(500000 + (n + 1) % 25 AS VARCHAR) END AS pin_code,
  CASE WHEN m = 2 THEN 'info@gmail.com' ELSE 'info@vendor' || k || '.com' END AS email, CASE WHEN m <> 2 THEN 'www.vendor' || k || '.com' END AS website,
  'SBIN' || CASE WHEN m = 2 THEN 'X' ELSE '0' END || lpad(CAST(k AS VARCHAR), 6, '0') AS ifsc, 'India' AS country,
  concat_ws(' ', 'address_2:value_resolved_from_combined_address', 'address_3:value_resolved_from_combined_address', 'city:value_resolved_from_combined_address',
    'state:value_resolved_from_combined_address', CASE WHEN m <> 2 THEN 'website:value_derived_not_printed' END, CASE WHEN m = 5 THEN 'vendor_name:missing_required_field' END,
    CASE m WHEN 1 THEN 'gst_number:validation_warning' WHEN 2 THEN 'ifsc:failed_validation' WHEN 3 THEN 'state:validation_warning' END,
    'address_2:low_confidence', 'address_3:low_confidence', 'city:low_confidence', CASE WHEN m = 2 THEN 'ifsc:low_confidence' END, 'state:low_confidence',
    CASE WHEN m <> 2 THEN 'website:low_confidence' END, CASE WHEN m = 4 THEN 'vendor_name:cross_document_mismatch' END,
    CASE WHEN m = 3 THEN 'pin_code:pin_state_mismatch' END) AS flags FROM p"""

RAW_PLACES = """raw AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN '12345' WHEN c_custkey % 17 <> 0 THEN ' ' || (500000 + (c_custkey // 3) % 700) END AS pincode, 'District ' || (c_nationkey % 4) AS district,
  CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 4 IN (0, 1) THEN 'West Bengal' ELSE 'State ' || (c_nationkey % 3) END AS state, c_custkey AS seq FROM customer)"""
ORACLE_SQL["lookup_build"] = f"""WITH {RAW_PLACES}, r AS (SELECT trim(pincode) AS pin, district, state, seq FROM raw WHERE regexp_full_match(trim(pincode), '[0-9]{{6}}') AND state <> ''),
  f AS (SELECT *, first_value(district) OVER w AS d, first_value(state) OVER w AS s FROM r WINDOW w AS (PARTITION BY pin ORDER BY seq))
SELECT pin, d AS district, s AS state, CAST(count(*) FILTER (WHERE district <> d OR state <> s) AS BIGINT) AS n_other FROM f GROUP BY pin, d, s"""
ORACLE_SQL["city_build"] = f"""WITH {RAW_PLACES} SELECT lower(district) AS name FROM raw UNION SELECT lower(n_name) FROM nation"""

ORACLE_SQL["caption_cleanup"] = """WITH v AS (SELECT s_suppkey, s_suppkey % 4 AS m, s_suppkey % 6 AS g,
  CASE s_suppkey % 4 WHEN 0 THEN 'Unit ' || s_suppkey WHEN 1 THEN 'Plot ' || s_suppkey WHEN 2 THEN 'FLAT NO. ' || s_suppkey || ', BLOCK C' ELSE 'Gate ' || s_suppkey END AS cleaned FROM supplier)
SELECT s_suppkey, CASE m WHEN 0 THEN 'Building No./Flat No.: ' WHEN 1 THEN 'Bui1ding No./Flat No - ' WHEN 2 THEN '' ELSE 'Address of Principal Place of: Building No./Flat No.: ' END || cleaned AS raw, cleaned,
  CASE g WHEN 0 THEN 'Address of Principal Place' WHEN 1 THEN 'Legal Narne of Business' WHEN 2 THEN 'Micro' WHEN 3 THEN 'Type of Thing' WHEN 4 THEN 'Trade Name, if any' ELSE 'Acme Trading ' || s_suppkey END AS name,
  CASE WHEN g = 5 THEN 0 ELSE 1 END AS leak FROM v"""

# A row's place is told from the row before it, one step for each row.
ORACLE_SQL["block_layout"] = f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  a AS (SELECT doc_id, i - 1 AS i, l[i] AS t, (i - 1) // 4 AS g, (i - 1) // 4 % 2 = 1 AS tab FROM l, unnest(range(1, len(l) + 1)) AS u(i)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, CASE WHEN NOT tab AND i % 4 = 0 THEN 66.0::DOUBLE ELSE 44.0::DOUBLE END AS h,
    max(len(string_split(t, ', '))) OVER (PARTITION BY doc_id, g) AS cols FROM a WHERE tab OR {stripped('t')} <> ''),
  w AS (SELECT doc_id, n, 1 AS page, 150.0::DOUBLE AS y, h FROM r WHERE n = 1
    UNION ALL SELECT r.doc_id, r.n, CASE WHEN w.y + w.h > 2188 THEN w.page + 1 ELSE w.page END, CASE WHEN w.y + w.h > 2188 THEN 150.0::DOUBLE ELSE w.y + w.h END, r.h FROM w JOIN r ON r.doc_id = w.doc_id AND r.n = w.n + 1),
  c AS (SELECT doc_id, n, i % 4 AS row_no, k - 1 AS col_no, {stripped("string_split(t, ', ')[k]")} AS t, 1354.0::DOUBLE / cols AS wide FROM r, unnest(range(1, len(string_split(t, ', ')) + 1)) AS u(k) WHERE tab
    UNION ALL SELECT doc_id, n, NULL, NULL, {stripped('t')}, least(length({stripped('t')}) * 15.0::DOUBLE, 1354.0::DOUBLE) FROM r WHERE NOT tab)
SELECT doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY n, col_no) - 1 AS INT) AS span_no, CAST(length(t) AS INT) AS chars, CAST(coalesce(row_no, -1) AS INT) AS row_no, CAST(coalesce(col_no, -1) AS INT) AS col_no,
  150.0::DOUBLE + coalesce(col_no, 0) * wide AS x1, y AS y1, 150.0::DOUBLE + coalesce(col_no, 0) * wide + wide AS x2, y + h AS y2 FROM c JOIN w USING (doc_id, n) WHERE t <> ''"""

ORACLE_SQL["eval_report"] = f"""WITH {V}, {TRUTH} SELECT packet_id, count(*) AS total, round_even(100.0 * count(*) FILTER (WHERE outcome IN ('correct', 'correctly_absent')) / count(*), 1) AS accuracy,
  count(*) FILTER (WHERE f IN ('pin_code', 'state', 'city', 'address_1', 'address_2')) AS block_fields,
  string_agg(f || ':' || outcome || CASE WHEN outcome IN ('hallucinated', 'correctly_absent') THEN ':-' ELSE '' END || CASE WHEN outcome IN ('missed', 'correctly_absent') THEN ':/' ELSE '' END, ',' ORDER BY f) AS told FROM o GROUP BY packet_id"""
ORACLE_SQL["nested_result"] = f"""WITH s AS ({ORACLE_SQL['packet_summary']}), r AS ({ORACLE_SQL['review_flags']}), c AS ({ORACLE_SQL['canonical_pivot']}),
  g AS (SELECT packet_id, count(*) AS n, string_agg(field_name, ',' ORDER BY stage, field_name, reason) AS names, string_agg(reason, ',' ORDER BY stage, field_name, reason) AS reasons FROM r GROUP BY packet_id)
SELECT packet_id, total, filled, valid, coalesce(n, 0) AS n_review, gst_number, country, coalesce(names, '') AS review, coalesce(reasons, '') AS reasons FROM s JOIN c USING (packet_id) LEFT JOIN g USING (packet_id)"""
