"""DuckDB SQL for the registered queries. Its constants are written out here, apart from the engine's own."""

from __future__ import annotations

import unicodedata

WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PERSIAN = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
PERSIAN_NO_FORMS_B = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}]"
PRIVATE, REPLACED, CONTROL = r"[\x{e000}-\x{f8ff}]", r"\x{fffd}", r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
READABLE = r"[\p{L}\p{N}\n\r\t \x{200c}]"
FORMS = r"[\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
UNSEEN = r"[\x{200b}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
DIACRITICS, SPACES = r"[\x{64b}-\x{65f}\x{670}]", r"[ \t\x{a0}\x{2000}-\x{200a}]+"
BEFORE_MARK = WS + r"+([,:.!\x{60c}\x{61b}\x{61f}])"
#: Letters, digits and marks, one for one, and tatweel, which goes.
FOLDS = {"ي": "ی", "ى": "ی", "ك": "ک", "أ": "ا", "إ": "ا", "ؤ": "و", "ئ": "ی", "ة": "ه", "ۀ": "ه", "،": ",", "؛": ";", "؟": "?", "٬": ",", "٫": "."}
FOLD_FROM = "".join(FOLDS) + "".join(chr(z + n) for z in (0x6F0, 0x660) for n in range(10)) + "\u0640"
FOLD_TO = "".join(FOLDS.values()) + "0123456789" * 2
DIGITS_FROM, DIGITS_TO = "".join(chr(z + n) for z in (0x6F0, 0x660) for n in range(10)), "0123456789" * 2
FORMULA = r"^[A-Za-z0-9+\-=→×·⇌()\[\]γδθλµ]{2,}$"
FOOTER_MARKS = ("دانلوداز", "وبسایت", "وبسايت", "اپليکيشن", "اپلیکیشن", "اپلكيش")
STATUSES = ("text_ok", "text_plus_visual", "text_broken", "scanned", "empty")
#: Ends of a line that is the tail of a sentence, and starts of one.
TAILS = (
    "مى دهد|می دهد|مي دهد|می\u200cدهد|می شود|مى شود|مي شود|می\u200cشود|میشود|می شوند|مى شوند|مي شوند|می\u200cشوند|میشوند|می باشند|مى باشند|میباشد|می باشد|ميباشد"
    "|می گردد|میگردد|می گیرد|میگیرد|می آید|میآید|می رود|میرود|دارد|دارند|است|بود|باشد|شد|شده است"
)
STARTS = "دارند|دارد|است|باشد|بود|شده|می|مي|مى|شود|شوند|دهند|کند|کنند"


def presentation_forms() -> dict[str, str]:
    return {chr(c): new for c in range(0xFB50, 0xFF00) if not 0xFE00 <= c < 0xFE70 and (new := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


WIDTH, HEIGHT = 595.0, 842.0
INJECTED = f"""CASE doc_id % 8 WHEN 0 THEN 'كتاب يك  ؟ ۱۲۳ ، سلام !' || chr(10) || 'فصل اول' || chr(10) || text
 WHEN 1 THEN 'ﺍﻣ کِتَاب ـ می‌روم' || chr(10) || text WHEN 2 THEN repeat('\ue001', 200) || '\ufffd\x01' || text WHEN 3 THEN 'H2O + Na2 = 5' || chr(10) || 'o O 0' || chr(10) || '25%' || chr(10) || 'وب سایت دانلود از' || chr(10) || text
 WHEN 4 THEN text || chr(10) || 'این متن دنباله دارد' || chr(10) || 'واژه می‌شود' WHEN 5 THEN text || chr(10) || 'Same footer line' ELSE text END"""
SPEC = "CASE doc_id % 4 WHEN 0 THEN '1,2,5-9' WHEN 1 THEN '' WHEN 2 THEN concat(cast(doc_id % 40 AS string), ', 3 , 3') ELSE '29-35,1' END"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def n(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS INT)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def compact(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w <> '')"


def digits(x: str) -> str:
    return f"translate({x}, {q(DIGITS_FROM)}, {q(DIGITS_TO)})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def formula(x: str) -> str:
    t = digits(f"replace({x}, ' ', '')")
    return f"(length({t}) <= 60 AND (({has(t, FORMULA)} AND {has(t, '[0-9]')}) OR ({has(t, '[A-Z][a-z]?[0-9]')} AND {has(t, '[+=→⇌-]')})))"


def english(x: str) -> str:
    t = compact(x)
    return f"({has(t, chr(94) + '[' + chr(92) + 'x00-' + chr(92) + 'x7f]*$')} AND {n(t, '[A-Za-z]')} >= 3 AND 10 * {n(t, '[A-Za-z]')} >= 7 * length({t}))"


def spam(x: str) -> str:
    w = words(x)
    return f"(CASE WHEN len({w}) < 3 THEN 0.0 ELSE len(list_filter({w}, lambda y: length(y) <= 2))::DOUBLE / len({w}) END)"


def decorative(x: str) -> str:
    return has(digits(compact(x)), "^[0Oo°○]{1,8}$")


def bare(x: str) -> str:
    return f"regexp_replace({x}, '^[().,]+|[().,]+$', '', 'g')"


def chart(x: str) -> str:
    digit = has(bare("y"), r"^\p{Nd}+$") + f" OR (length({bare('y')}) <= 5 AND " + has(bare("y"), r"^\p{Nd}") + ")"
    return f"(len({words(x)}) <= 3 AND ({has(x, '[%٪]')} OR len(list_filter({words(x)}, lambda y: {digit})) > 0))"


def footer(x: str) -> str:
    return "(" + " OR ".join(f"contains({compact(x)}, {q(m)})" for m in FOOTER_MARKS) + ")"


def ratio(x: str) -> str:
    return f"coalesce({n(x, PERSIAN)}::DOUBLE / nullif(length({x}) - {n(x, WS)}, 0), 0.0)"


def normalized(x: str) -> str:
    forms = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in presentation_forms().items()) + "}"
    x = f"nfc_normalize({x})"
    x = f"(CASE WHEN {has(x, FORMS)} THEN array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({forms}[c], c)), '') ELSE {x} END)"
    x = f"regexp_replace(translate(regexp_replace({x}, {q(UNSEEN)}, '', 'g'), {q(FOLD_FROM)}, {q(FOLD_TO)}), {q(DIACRITICS)}, '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {q(BEFORE_MARK)}, '\\1', 'g'), {q(SPACES)}, ' ', 'g')"
    return strip(x)


def tokens(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length({x}) / 3.2::DOUBLE, 0) AS INT)) END)"


D = f"d AS (SELECT doc_id, source, lang, {INJECTED} AS text FROM documents)"
P = f"""{D}, s AS (SELECT source AS document_id, doc_id AS page_number, text, CAST(length(text) AS INT) AS char_count, {n("text", READABLE)} AS readable_char_count, {n("text", PERSIAN_NO_FORMS_B)} AS persian_char_count,
 {n("text", PRIVATE)} AS pua_char_count, {n("text", REPLACED)} AS replacement_char_count, {n("text", CONTROL)} AS control_char_count, doc_id % 3 AS img, (doc_id % 10) / 10.0::DOUBLE AS area, doc_id % 25 AS draw FROM d)"""
G = f"""{P}, r AS (SELECT *, coalesce((pua_char_count + replacement_char_count + control_char_count)::DOUBLE / nullif(char_count, 0), 0) AS br, coalesce(persian_char_count::DOUBLE / nullif(readable_char_count, 0), 0) AS pr FROM s),
g0 AS (SELECT *, CASE WHEN char_count = 0 AND img = 0 AND draw = 0 THEN 'empty' WHEN char_count < 50 AND char_count > 0 AND br >= 0.1 THEN 'text_broken' WHEN char_count < 50 THEN 'scanned'
 WHEN br >= 0.1 OR greatest(readable_char_count, persian_char_count) < 20 THEN 'text_broken' WHEN (img >= 1 AND area >= 0.3) OR draw >= 20 THEN 'text_plus_visual' ELSE 'text_ok' END AS status FROM r),
g AS (SELECT *, CASE status WHEN 'text_ok' THEN 'text_extract_sorted' WHEN 'text_plus_visual' THEN 'hybrid' WHEN 'empty' THEN 'skip' ELSE 'ocr' END AS method FROM g0)"""
B = f"""{D}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
w AS (SELECT doc_id, k, {words("line")} AS ws FROM ln), c AS (SELECT doc_id, k, j, ws[j * 10 + 1:j * 10 + 10] AS w FROM w, unnest(range(0, (len(ws) + 9) // 10)) AS r(j)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pos, w FROM c),
h AS (SELECT *, CASE WHEN pos % 5 = 0 AND len(w) >= 2 THEN (len(w) + 1) // 2 ELSE len(w) END AS cut FROM p),
f AS (SELECT 'd' || doc_id AS document_id, CAST(pos // 40 + 1 AS INT) AS page_number, pos, array_to_string(w[1:cut], ' ') AS a, array_to_string(w[cut + 1:10], ' ') AS z, 72.0::DOUBLE + 18 * (pos % 40) AS t, 72.0::DOUBLE + 18 * (pos % 40) + CASE WHEN pos % 7 = 0 THEN 18 ELSE 12 END AS b, (25 + (doc_id * 31 + pos * 17) % 76) / 100.0::DOUBLE AS score FROM h),
blocks AS (SELECT document_id, page_number, pos, CAST(pos * 2 AS INT) AS block_idx, a AS text, score, 72.0::DOUBLE AS l, t, 72.0::DOUBLE + 6 * length(a) AS r, b FROM f
 UNION ALL SELECT document_id, page_number, pos, CAST(pos * 2 + 1 AS INT), z, score, 78.0::DOUBLE + 6 * length(a), t, 78.0::DOUBLE + 6 * length(a) + 6 * length(z), b FROM f WHERE z <> ''),
lines AS (SELECT document_id, page_number, pos % 40 + 1 AS line_id, CASE WHEN z = '' THEN a ELSE z || ' ' || a END AS text, 72.0::DOUBLE AS l, t, 72.0::DOUBLE + 6 * length(a) + CASE WHEN z = '' THEN 0 ELSE 6 + 6 * length(z) END AS r, b, score AS mean_score FROM f)"""
MID, SLACK = WIDTH / 2, 0.02 * WIDTH
_PUNCT = "[,.،;:]$"
_LINE_END, _ASCII = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", r"^[\x{0}-\x{7f}]*$"


def columns(p: str = "") -> str:
    """Columns by page of the table {p}lines."""
    return f"""{p}cc AS (SELECT document_id, page_number, count(*) AS n, count(*) FILTER (WHERE r <= {MID + SLACK}) AS n_left, count(*) FILTER (WHERE l >= {MID - SLACK}) AS n_right, count(*) FILTER (WHERE r > {MID + SLACK} AND l < {MID - SLACK}) AS n_crossing FROM {p}lines GROUP BY ALL),
{p}cols AS (SELECT *, CASE WHEN n >= 8 AND n_left >= 3 AND n_right >= 3 AND n_crossing <= greatest(2, floor(0.2 * n)) THEN 2 ELSE 1 END AS columns FROM {p}cc)"""


def typed(p: str = "") -> str:
    """Order and types of {p}lines."""
    return f"""{columns(p)}, {p}o AS (SELECT {p}lines.*, row_number() OVER (PARTITION BY document_id, page_number ORDER BY CASE WHEN columns = 2 AND (l + r) / 2 < {MID} THEN 1 ELSE 0 END, t, line_id) AS position,
 median(b - t) OVER (PARTITION BY document_id, page_number) AS mh, max(r - l) OVER (PARTITION BY document_id, page_number) AS mw FROM {p}lines JOIN {p}cols USING (document_id, page_number)),
{p}x AS MATERIALIZED (SELECT *, {words("text")} AS w, length({compact("text")}) AS nc, {has("text", PERSIAN)} AS fa, {footer("text")} AS foot FROM {p}o),
{p}lt AS (SELECT *, CASE WHEN nc = 0 THEN 'noise' WHEN b >= {0.90 * HEIGHT} AND (foot OR len(w) <= 6) THEN 'noise' WHEN foot OR {decorative("text")} THEN 'noise' WHEN {spam("text")} >= 0.5 AND len(w) >= 3 THEN 'noise'
 WHEN {formula("text")} OR {chart("text")} THEN 'special' WHEN {english("text")} AND NOT fa THEN 'special'
 WHEN NOT fa AND (nc <= 3 OR (nc <= 10 AND mean_score < 0.75) OR {n("text", chr(92) + "p{L}")} < 3) THEN 'noise' WHEN {ratio("text")} < 0.35 AND nc <= 12 AND mean_score < 0.75 THEN 'noise'
 WHEN {has(strip("text"), f"(?:{TAILS})$")} OR {has("w[1]", f"^(?:{STARTS})")} OR len(list_filter(w, lambda y: {has(bare("y"), "^" + chr(92) + "p{Nd}{1,2}$")})) > 0 THEN 'body'
 WHEN len(w) BETWEEN 2 AND 8 AND (CASE WHEN mw > 0 THEN r - l < 0.5 * mw ELSE r - l < 300 END) AND (b - t > 1.25 * mh OR len(w) <= 6) AND NOT {has(strip("text"), _PUNCT)} THEN 'heading' ELSE 'body' END AS line_type FROM {p}x)"""


def regions(p: str = "", text: str = "text") -> str:
    """Regions of {p}lines, with the text of another column if asked; {p}i has their lines."""
    win = "(PARTITION BY document_id, page_number ORDER BY position)"
    return f"""{typed(p)}, {p}e AS (SELECT *, lag(line_type) OVER {win} AS pt, t - lag(b) OVER {win} AS gap, lead(line_type) OVER {win} AS nt FROM {p}lt),
{p}i AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt <> line_type OR line_type = 'heading' OR (line_type = 'special' AND gap > 3.0 * mh) OR (line_type = 'body' AND gap > 0.9 * mh) THEN 1 ELSE 0 END) OVER {win} AS island FROM {p}e),
{p}rg0 AS (SELECT document_id, page_number, island, first(line_type) AS role, coalesce(string_agg({text}, ' ' ORDER BY position) FILTER ({text} <> ''), '') AS text, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, avg(mean_score) AS sc, count(*) AS n_lines
 FROM {p}i WHERE line_type <> 'noise' AND NOT (line_type = 'heading' AND coalesce(nt = 'body', false)) GROUP BY ALL),
{p}rg AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY island) - 1 AS region_idx FROM {p}rg0)"""


NOISE = f"""CASE WHEN nc = 0 THEN true WHEN {footer("text")} THEN true WHEN {formula("text")} OR {english("text")} THEN false WHEN {compact("text")} IN ('O', 'o', '0', 'Q', '©', '®') OR {decorative("text")} THEN true
 WHEN nc = 1 AND score < 0.8 THEN true WHEN nc = 2 AND score < 0.6 THEN true WHEN NOT {has("text", PERSIAN)} THEN nc <= 8 AND score < 0.75 WHEN {ratio("text")} < 0.45 AND nc <= 10 AND score < 0.75 THEN true ELSE {spam("text")} >= 0.5 END"""
FILTERED = f"(score >= 0.55 OR ({formula('text')} AND score >= 0.3)) AND NOT ({NOISE})"
COLS = f"{B}, {columns()}"
LT = f"{B}, {typed()}"
RG = f"{B}, {regions()}"


def lines_of(p: str) -> str:
    """{p}lines of {p}blocks: the blocks of a band, right to left."""
    order = "ORDER BY -(l + r) / 2, block_idx"
    return f"""{p}lines AS (SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY pos) AS line_id, string_agg(text, ' ' {order}) FILTER (text <> '') AS text, coalesce(string_agg(clean, ' ' {order}) FILTER (clean <> ''), '') AS clean,
 min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, avg(score) AS mean_score FROM {p}blocks GROUP BY document_id, page_number, pos)"""


def page_texts(p: str) -> str:
    return f"{p}pt AS (SELECT document_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY region_idx) FILTER (text <> '') AS text FROM {p}rg GROUP BY 1, 2)"


#: Diagnosis and routes of the pages of blocks; the text path (a) on normalized, the OCR path (s) on raw text. ``done`` has
#: every page but the empty ones under the method that served it.
RUN = f"""{B}, ob AS (SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY block_idx) AS text FROM blocks GROUP BY 1, 2),
os AS (SELECT *, CAST(length(text) AS INT) AS cc, {n("text", READABLE)} AS rc, {n("text", PERSIAN_NO_FORMS_B)} AS pc, {n("text", PRIVATE)} + {n("text", REPLACED)} + {n("text", CONTROL)} AS bad, page_number % 3 AS img FROM ob),
st AS (SELECT document_id, page_number, CASE WHEN cc = 0 AND img = 0 THEN 'empty' WHEN cc < 50 AND cc > 0 AND bad::DOUBLE / cc >= 0.1 THEN 'text_broken' WHEN cc < 50 THEN 'scanned' WHEN bad::DOUBLE / cc >= 0.1 OR greatest(rc, pc) < 20 THEN 'text_broken' WHEN img >= 1 THEN 'text_plus_visual' ELSE 'text_ok' END AS status FROM os),
ablocks0 AS (SELECT blocks.* REPLACE ({normalized("text")} AS text) FROM blocks JOIN st USING (document_id, page_number) WHERE status IN ('text_ok', 'text_plus_visual')),
ablocks AS MATERIALIZED (SELECT *, text AS clean FROM (SELECT *, length({compact("text")}) AS nc FROM ablocks0 WHERE text <> '') WHERE {FILTERED}),
{lines_of("a")}, {regions("a")}, {page_texts("a")},
tp AS (SELECT document_id, page_number, status, coalesce(apt.text, '') AS text, length(coalesce(apt.text, '')) < 40 AS late FROM st LEFT JOIN apt USING (document_id, page_number) WHERE status IN ('text_ok', 'text_plus_visual')),
sc AS (SELECT document_id, page_number, status, false AS late FROM st WHERE status IN ('text_broken', 'scanned') UNION ALL SELECT document_id, page_number, status, true FROM tp WHERE late),
sblocks0 AS (SELECT blocks.*, length({compact("text")}) AS nc FROM blocks SEMI JOIN sc USING (document_id, page_number)),
sblocks AS MATERIALIZED (SELECT *, {normalized("text")} AS clean FROM sblocks0 WHERE {FILTERED}),
{lines_of("s")}, {regions("s", "clean")}, {page_texts("s")},
done AS (SELECT document_id, page_number, status, 'text' AS source_method, false AS fallback_used, text FROM tp WHERE NOT late UNION ALL SELECT document_id, page_number, status, 'ocr', late, coalesce(spt.text, '') FROM sc LEFT JOIN spt USING (document_id, page_number))"""
#: Regions of the served pages without the lines that repeat through a document.
STRIPPED = f"""{RUN}, al AS (SELECT document_id, page_number, clean FROM alines SEMI JOIN (SELECT * FROM done WHERE source_method = 'text') USING (document_id, page_number) UNION ALL SELECT document_id, page_number, clean FROM slines),
pc AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM al GROUP BY 1 HAVING count(DISTINCT page_number) >= 4),
rp AS (SELECT document_id, x FROM (SELECT DISTINCT document_id, page_number, {strip("clean")} AS x FROM al) JOIN pc USING (document_id) WHERE length(x) >= 3 GROUP BY document_id, x, pages HAVING count(*) >= greatest(2, floor(pages * 0.6))),
il AS (SELECT document_id, page_number, island, position, clean FROM ai SEMI JOIN (SELECT * FROM done WHERE source_method = 'text') USING (document_id, page_number) WHERE line_type <> 'noise' AND NOT (line_type = 'heading' AND coalesce(nt = 'body', false))
 UNION ALL SELECT document_id, page_number, island, position, clean FROM si WHERE line_type <> 'noise' AND NOT (line_type = 'heading' AND coalesce(nt = 'body', false))),
kl AS (SELECT * FROM il WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.document_id = il.document_id AND rp.x = {strip("il.clean")})),
kr AS (SELECT document_id, page_number, island, string_agg(clean, ' ' ORDER BY position) FILTER (clean <> '') AS text FROM kl GROUP BY 1, 2, 3),
kp AS (SELECT document_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY island) FILTER (text <> '') AS text FROM kr GROUP BY 1, 2)"""
#: Paragraph pieces of whole texts: parts of long sentences first, then group numbers from lengths, then small pieces merged.
PIECES = f"""{D}, sn AS (SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(text, {q("([.?!؟…])" + WS + "+")}, chr(92) || '1' || chr(3), 'g'), chr(10), chr(3)), chr(3)), lambda y: {strip("y")}), lambda y: y <> '') AS ss FROM d WHERE length(text) > 900),
se AS (SELECT doc_id, generate_subscripts(ss, 1) AS s, unnest(ss) AS x FROM sn),
cut AS (SELECT doc_id, s, 0 AS c, NULL::VARCHAR AS head, x AS rest FROM se UNION ALL
 SELECT doc_id, s, c + 1, {strip("rest[1:k]")}, {strip("rest[k + 1:]")} FROM (SELECT *, CASE WHEN length(regexp_extract(rest[1:900], '(?s)^(.*)،', 1)) >= 450 THEN length(regexp_extract(rest[1:900], '(?s)^(.*)،', 1)) WHEN length(regexp_extract(rest[1:900], '(?s)^(.*) ', 1)) >= 450 THEN length(regexp_extract(rest[1:900], '(?s)^(.*) ', 1)) ELSE 900 END AS k FROM cut WHERE length(rest) > 900)),
un AS (SELECT doc_id, s, c, head AS x, true AS closes FROM cut WHERE head IS NOT NULL UNION ALL SELECT doc_id, s, 100000, rest, false FROM cut WHERE length(rest) <= 900 AND rest <> ''),
nu AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, c) AS i, x, length(x) AS n, closes FROM un),
gr AS (SELECT doc_id, i, n, closes, 1 AS g, true AS fresh FROM nu WHERE i = 1 UNION ALL
 SELECT doc_id, nu.i, CASE WHEN gr.closes OR (NOT nu.closes AND gr.n + 1 + nu.n > 900) THEN nu.n ELSE gr.n + 1 + nu.n END, nu.closes, CASE WHEN gr.closes OR (NOT nu.closes AND gr.n + 1 + nu.n > 900) THEN g + 1 ELSE g END, gr.closes OR (NOT nu.closes AND gr.n + 1 + nu.n > 900)
 FROM gr JOIN nu USING (doc_id) WHERE nu.i = gr.i + 1),
pi AS (SELECT doc_id, g, string_agg(CASE WHEN fresh OR nu.closes THEN '' ELSE ' ' END || x, '' ORDER BY i) AS x FROM gr JOIN nu USING (doc_id, i) GROUP BY 1, 2 UNION ALL SELECT doc_id, 1, text FROM d WHERE length(text) <= 900),
pl AS MATERIALIZED (SELECT doc_id, g, x, length(x) AS n FROM pi),
sm AS (SELECT doc_id, g, n, 0 AS m FROM pl WHERE g = 1 UNION ALL SELECT doc_id, pl.g, CASE WHEN sm.n < 80 AND sm.n + 1 + pl.n <= 900 THEN sm.n + 1 + pl.n ELSE pl.n END, CASE WHEN sm.n < 80 AND sm.n + 1 + pl.n <= 900 THEN m ELSE m + 1 END FROM sm JOIN pl USING (doc_id) WHERE pl.g = sm.g + 1),
pf AS (SELECT doc_id, m, string_agg(x, ' ' ORDER BY g) AS text FROM sm JOIN pl USING (doc_id, g) GROUP BY 1, 2)"""
RENDERED = """'[' || CASE WHEN doc_id % 2 = 0 THEN 'صفحه ' || (doc_id % 7 + 1) ELSE 'صفحه‌های ' || (doc_id % 7 + 1) || '-' || (doc_id % 7 + 1 + doc_id % 2) END || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'متن' ELSE 'OCR' END
 || CASE WHEN doc_id % 4 = 0 AND lang <> '' THEN ' | بخش: ' || lang ELSE '' END || ']' || chr(10) || text"""
TF = f"{D}, n AS MATERIALIZED (SELECT doc_id AS chunk_id, {normalized('text')} AS t FROM d), tk AS (SELECT chunk_id, unnest({words('t')}) AS token FROM n), tf AS (SELECT chunk_id, token, count(*) AS tf FROM tk WHERE length(token) >= 2 GROUP BY ALL), idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY token)"
TOP = f"""{TF}, bn AS MATERIALIZED (SELECT item_id AS query_id, {normalized("text")} AS t FROM benchmark), bq AS (SELECT query_id, unnest({words("t")}) AS token FROM bn), ask AS (SELECT query_id, token, count(*) AS times FROM bq WHERE length(token) >= 2 GROUP BY ALL),
hits AS (SELECT query_id, chunk_id, sum(times * (1 + ln(tf)) * idf) AS score FROM ask JOIN tf USING (token) JOIN idf USING (token) GROUP BY ALL HAVING sum(times * (1 + ln(tf)) * idf) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 4)"""
LN = "WITH " + D + ", sl AS (SELECT source || '-' || doc_id % 8 AS document_id, doc_id AS page_number, unnest(string_split(text, chr(10))) AS text FROM d), pg AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM sl GROUP BY 1 HAVING count(DISTINCT page_number) >= 4), st AS (SELECT DISTINCT document_id, page_number, " + strip("text") + " AS text FROM sl), rep AS (SELECT document_id, text FROM st JOIN pg USING (document_id) WHERE length(text) >= 3 GROUP BY document_id, text, pages HAVING count(*) >= greatest(2, floor(pages * 0.6)))"
CACHED = f"WITH {D}, n AS (SELECT source AS document_id, CAST(doc_id AS INT) AS page_no, text, sha256(text) AS c, 200 AS dpi, CASE WHEN doc_id % 5 = 0 THEN 'ocr' ELSE 'text' END AS m FROM d), o AS (SELECT document_id, page_no, text, c, CASE WHEN page_no % 7 = 0 THEN 300 ELSE 200 END AS dpi, m FROM n WHERE page_no % 3 <> 0)"


def sql() -> dict[str, str]:
    counts = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in STATUSES)
    order = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATUSES)) + " END"
    usd = "((t + 20) * 0.0000025::DECIMAL(18, 8))"
    sentinel = f"replace(regexp_replace(text, {q('([.?!؟…])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(10), chr(1))"
    letters_fa = r"[\x{620}-\x{64a}\x{66e}\x{66f}\x{671}-\x{6d3}\x{6d5}\x{6e5}\x{6e6}\x{6ee}\x{6ef}\x{6fa}-\x{6fc}\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fbb1}\x{fbd3}-\x{fd3d}\x{fe70}-\x{fefc}]"
    blank = f"lambda y: {strip('y')} <> ''"
    return {
        "object_stats": f"WITH {P} SELECT page_number AS doc_id, char_count, readable_char_count, CAST(len(list_filter(string_split(text, chr(10)), {blank})) AS INT) AS text_block_count, round(least(((page_number % 7) * 100000.0::DOUBLE + (page_number % 3) * 50000.0::DOUBLE) / {WIDTH * HEIGHT}::DOUBLE, 1.0::DOUBLE), 6) AS image_area_ratio FROM s",
        "page_text": f"WITH {RG} SELECT document_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY region_idx) AS text FROM rg GROUP BY 1, 2",
        "reading_order": f"WITH {LT} SELECT document_id, page_number, line_id, position FROM o",
        "question_bench": f"WITH {TOP}, hp AS (SELECT query_id, unnest(range(chunk_id % 50, chunk_id % 50 + chunk_id % 2 + 1)) AS p FROM top), pp AS (SELECT query_id, array_to_string(list_sort(list(p)), ',') AS pages, bool_or(p IN (query_id % 50, query_id % 50 + 1)) AS hit FROM (SELECT DISTINCT * FROM hp) GROUP BY 1), cx AS (SELECT query_id, string_agg(d.text, chr(10) || chr(10)) AS c FROM top JOIN d ON d.doc_id = chunk_id GROUP BY 1), qs AS (SELECT item_id AS query_id, coalesce(pages, '') AS pages, coalesce(hit, false) AS page_hit, {tokens("coalesce(c, '')")} AS rag_tokens, {tokens("text")} AS qt FROM benchmark LEFT JOIN pp ON pp.query_id = item_id LEFT JOIN cx ON cx.query_id = item_id) SELECT query_id, pages, page_hit, rag_tokens, 1000000 + qt AS baseline_tokens, round(100 * (1 - (rag_tokens + qt)::DOUBLE / (1000000 + qt)), 1) AS reduction FROM qs",
        "process_pages": f"WITH {RUN} SELECT document_id, page_number, status, source_method, fallback_used, CAST(length(text) AS INT) AS n_chars FROM done UNION ALL SELECT document_id, page_number, status, 'ocr', false, 0 FROM st WHERE status = 'empty'",
        "ingest_job": f"WITH {RUN}, every AS (SELECT document_id, page_number, status, source_method FROM done UNION ALL SELECT document_id, page_number, status, 'ocr' FROM st WHERE status = 'empty'), sel AS (SELECT *, bool_or(page_number IN (2, 3)) OVER (PARTITION BY document_id) AS hit FROM every) SELECT document_id, count(*) AS pages_done, string_agg(page_number || '=' || source_method, ',' ORDER BY page_number) AS method_per_page, string_agg(page_number || '=' || status, ',' ORDER BY page_number) AS status_per_page FROM sel WHERE NOT hit OR page_number IN (2, 3) GROUP BY 1",
        "strip_pipeline": f"WITH {STRIPPED} SELECT document_id, page_number, source_method, sha256(coalesce(kp.text, '')) AS text_sha256, CAST(length(coalesce(kp.text, '')) AS INT) AS n_chars FROM done LEFT JOIN kp USING (document_id, page_number)",
        "persian_text": f"WITH {D}, pl AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {q(_LINE_END)}), lambda y: {normalized('y')}), lambda y: y <> '') AS ls FROM d) SELECT doc_id, array_to_string(ls, chr(10)) AS normalized FROM pl",
        "split_paragraph": f"WITH RECURSIVE {PIECES} SELECT 'd' || p.doc_id || '-c' || lpad(m::VARCHAR, 4, '0') AS chunk_id, CASE WHEN regexp_matches(d.text, {q(_ASCII)}) THEN 'special' ELSE 'paragraph' END AS chunk_type, p.text, CAST(length(p.text) AS INT) AS char_count FROM pf p JOIN d USING (doc_id)",
        "page_text_stats": f"WITH {P} SELECT document_id, page_number, char_count, readable_char_count, persian_char_count, pua_char_count, replacement_char_count, control_char_count FROM s",
        "page_diagnosis": f"WITH {G} SELECT document_id, page_number, status, method, round(br, 4) AS broken_ratio, round(pr, 4) AS persian_ratio FROM g",
        "document_diagnosis": f"WITH {G}, k AS (SELECT document_id, status, count(*) AS c FROM g GROUP BY ALL), dom AS (SELECT document_id, first(status ORDER BY c DESC, {order}) AS dominant_status FROM k GROUP BY 1) SELECT document_id, count(*) AS page_count, {counts}, first(dominant_status) AS dominant_status, CASE WHEN bool_or(method = 'ocr') AND bool_or(method IN ('text_extract_sorted', 'hybrid')) THEN 'hybrid' WHEN bool_or(method = 'ocr') THEN 'ocr' WHEN bool_or(method IN ('text_extract_sorted', 'hybrid')) THEN 'text_extract_sorted' ELSE 'skip' END AS method FROM g JOIN dom USING (document_id) GROUP BY document_id",
        "pages_with_status": f"WITH {G} SELECT document_id, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS pages FROM g WHERE status IN ('text_broken', 'scanned') GROUP BY 1",
        "normalize_text": f"WITH {D} SELECT doc_id, {normalized('text')} AS normalized FROM d",
        "persian_features": f"WITH {D} SELECT doc_id, {has('text', PERSIAN)} AS has_persian, round({ratio('text')}, 4) AS ratio, coalesce({n('text', letters_fa)}::DOUBLE / nullif({n('text', chr(92) + 'p{L}')}, 0) >= 0.01, false) AS mostly FROM d",
        "text_features": f"WITH {B} SELECT document_id, block_idx, {formula('text')} AS formula, {english('text')} AS english, round({spam('text')}, 4) AS spam, {decorative('text')} AS decorative, {chart('text')} AS chart, {footer('text')} AS footer FROM blocks",
        "noise_block_filter": f"WITH {B}, x AS (SELECT *, length({compact('text')}) AS nc FROM blocks) SELECT document_id, block_idx FROM x WHERE {FILTERED}",
        "group_lines": f"WITH {B} SELECT document_id, page_number, line_id, text, l, t, r, b, round(mean_score, 4) AS mean_score FROM lines",
        "column_count": f"WITH {COLS} SELECT document_id, page_number, n, n_left, n_right, n_crossing, columns FROM cols",
        "line_types": f"WITH {LT} SELECT document_id, page_number, position, line_type FROM lt",
        "regions": f"WITH {RG} SELECT document_id, page_number, region_idx, role, text, n_lines, l, t, r, b, round(sc, 4) AS score, CASE WHEN role = 'body' THEN last_value(CASE WHEN role = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS heading_text FROM rg",
        "repeated_lines": f"{LN} SELECT document_id, text FROM rep",
        "strip_repeated": f"{LN} SELECT document_id, count(*) AS n_lines FROM sl WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.document_id = sl.document_id AND rep.text = {strip('sl.text')}) GROUP BY 1",
        "sentence_split": f"WITH {D}, z AS (SELECT doc_id, list_filter(list_transform(string_split({sentinel}, chr(1)), lambda y: {strip('y')}), lambda y: y <> '') AS ss FROM d WHERE doc_id % 8 <> 2 UNION ALL SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(replace(text, chr(1), chr(2)), {q('([.?!؟…])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda y: {strip('replace(y, chr(2), chr(1))')}), lambda y: y <> '') FROM d WHERE doc_id % 8 = 2) SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS n, unnest(ss) AS sentence FROM z",
        "parse_pages": f"WITH {D}, v AS (SELECT doc_id, {SPEC.replace('AS string', 'AS VARCHAR')} AS spec FROM d), u AS (SELECT doc_id, trim(unnest(string_split(spec, ','))) AS p FROM v WHERE spec <> ''), y AS (SELECT doc_id, unnest(CASE WHEN contains(p, '-') THEN range(split_part(p, '-', 1)::INT, split_part(p, '-', 2)::INT + 1) ELSE [p::INT] END) AS k FROM u), a AS (SELECT doc_id, string_agg(DISTINCT k::VARCHAR, ',' ORDER BY k) AS pages FROM (SELECT DISTINCT doc_id, k FROM y WHERE k BETWEEN 1 AND 30) GROUP BY 1) SELECT d.doc_id, a.pages FROM d LEFT JOIN a USING (doc_id)".replace("string_agg(DISTINCT k::VARCHAR", "string_agg(k::VARCHAR"),
        "document_id": "SELECT page_id, 'p.' || page_id || '-' || substr(sha256(html), 1, 8) AS document_id FROM pages",
        "token_estimate": f"WITH {D} SELECT source, CAST(sum({tokens('text')}) AS BIGINT) AS tokens FROM d GROUP BY 1",
        "scenario_cost": f"WITH {D}, t AS (SELECT doc_id, {tokens('text')} AS t FROM d) SELECT doc_id, t AS context, CAST(t + 20 AS INT) AS input_tokens, CAST(t + 370 AS INT) AS total_tokens, round({usd}, 4)::DOUBLE AS input_cost_usd, 0.0035::DOUBLE AS output_cost_usd, round({usd} + 0.0035::DECIMAL(18, 8), 4)::DOUBLE AS total_cost_usd, CAST(round_even(({usd} + 0.0035::DECIMAL(18, 8))::DOUBLE * 230000, 0) AS BIGINT) AS total_cost_toman FROM t",
        "tf": f"WITH {TF} SELECT chunk_id, token, tf FROM tf",
        "idf": f"WITH {TF} SELECT token, df, round(idf, 4) AS idf FROM idf",
        "lexical_topk": f"WITH {TOP} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM top",
        "render_chunk": f"WITH {D} SELECT doc_id, {RENDERED} AS rendered FROM d",
        "pack_context": f"WITH {D}, x AS (SELECT source, doc_id, {RENDERED} AS y FROM d), z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, coalesce(sum(length(y) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x) SELECT source, string_agg(y, chr(10) || chr(10) ORDER BY doc_id) AS context, count(*) AS n_chunks FROM z WHERE k = 1 OR before + length(y) <= 6000 GROUP BY 1",
        "history_filter": "SELECT conv_id, string_agg(role || '=' || text, chr(10) ORDER BY turn) AS history FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\\S') GROUP BY 1",
        "build_messages": "WITH h AS (SELECT conv_id, count(*) AS c, string_agg(role, ',' ORDER BY turn) AS r FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\\S') GROUP BY 1) SELECT item_id AS query_id, CAST(2 + coalesce(c, 0) AS INT) AS n, 'system,' || coalesce(r || ',', '') || 'user' AS roles, text || chr(10) || chr(10) || '<document_context>' || chr(10) || '[c]' || chr(10) || '</document_context>' AS asked FROM benchmark LEFT JOIN h ON conv_id = item_id",
        "route_method": f"WITH {G} SELECT document_id, page_number, CASE WHEN status <> 'empty' AND method = 'ocr' THEN 'ocr' ELSE 'text' END AS auto, CASE WHEN status <> 'empty' AND method IN ('ocr', 'hybrid') THEN 'ocr' ELSE 'text' END AS hybrid FROM g",
        "text_fallback": f"WITH {G} SELECT document_id, page_number FROM g WHERE length(text) < 200 AND status IN ('text_ok', 'text_plus_visual')",
        "cache_hits": f"{CACHED} SELECT n.document_id, n.page_no, coalesce(o.dpi = n.dpi AND o.c = n.c AND o.m = n.m, false) AS cache_hit, CAST(CASE WHEN o.dpi = n.dpi THEN length(o.text) END AS INT) AS cached_chars FROM n LEFT JOIN o USING (document_id, page_no)",
        "cache_misses": f"{CACHED} SELECT document_id, page_no FROM n ANTI JOIN o USING (document_id, page_no, c, dpi, m)",
        "job_rollup": f"WITH {G} SELECT document_id, count(*) AS pages_done, count(DISTINCT page_number) AS n_methods, count(*) FILTER (WHERE status <> 'empty' AND method = 'ocr') AS n_ocr FROM g GROUP BY 1",
        "bench_summary": f"WITH {TOP}, tx AS (SELECT doc_id AS chunk_id, {tokens('text')} AS tokens FROM d), ea AS (SELECT query_id, sum(tokens) AS rag, bool_or(chunk_id % 10 = query_id % 10) AS hit FROM top JOIN tx USING (chunk_id) GROUP BY 1) SELECT count(*) AS n, round(avg(hit::INT), 2) AS hit_rate, round(avg(rag), 1) AS mean_rag_tokens, round(avg(100 * (1 - rag::DOUBLE / (SELECT sum(tokens) FROM tx))), 1) AS mean_reduction FROM ea",
    }
