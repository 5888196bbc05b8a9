"""DuckDB SQL that must give the rows of the query of the same name in `queries`."""

from __future__ import annotations

import json

from tunedata import dims
from tunedata.functions import chat
from tunedata.functions.text import WHITESPACE
from tunedata.operators import logs as L
from tunedata.operators.configs import BETA_TASKS
from tunedata.operators.chats import TURNS_PER_PIECE
from tunedata.plans import tables as A
from tunedata.plans.queries import DATE, TOOLS

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    """A SQL string literal; line breaks are spelled with chr()."""
    quoted = text.replace("'", "''")
    return "('" + quoted.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "')"


NL = "chr(10)"
SPACE = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


# --- chats -----------------------------------------------------------------------------------
def parts(size: int = TURNS_PER_PIECE) -> str:
    return f"(SELECT *, turn // {size} - min(turn // {size}) OVER (PARTITION BY conv_id) AS piece, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"


PARTS = parts()


def generic_chat(role: str) -> str:
    return f"""SELECT conv_id, piece, string_agg('<|' || {role} || '|>' || {NL} || text, {NL} ORDER BY turn) || {NL} AS text
    FROM {PARTS} GROUP BY conv_id, piece"""


ORACLES["chatml_sft_text"] = generic_chat("role")
ORACLES["sharegpt_sft_text"] = generic_chat("CASE role WHEN 'system' THEN 'user' ELSE role END")


def header(role: str) -> str:
    return lit(chat.HEADER_OPEN) + f" || {role} || " + lit(chat.HEADER_CLOSE)


EOT = lit(chat.END_OF_TURN)
LLAMA_TURN = f"{header('role')} || {strip('text')} || {EOT}"
SYSTEM_TEXT = f"coalesce(max(CASE WHEN turn = first_turn AND role = 'system' THEN {strip('text')} END), '')"
LLAMA_REST = f"coalesce(string_agg(CASE WHEN NOT (piece = 0 AND turn = first_turn AND role = 'system') THEN {LLAMA_TURN} END, '' ORDER BY turn), '')"
def ordered_parts(size: int = TURNS_PER_PIECE) -> str:
    return f"(SELECT *, min(turn) OVER (PARTITION BY conv_id, piece) AS first_turn FROM {parts(size)})"


ORDERED_PARTS = ordered_parts()


def opening(environment: str = "") -> str:
    head = lit(chat.BEGIN) + " || " + header("'system'") + " || " + lit(
        environment + chat.KNOWLEDGE_LINE + chat.TODAY_PREFIX + DATE + "\n\n"
    )
    return f"{head} || {SYSTEM_TEXT} || {EOT}"


def llama_chat(closing: str = "''", name: str = "text") -> str:
    return f"""CASE WHEN piece = 0 THEN {opening()} ELSE '' END || {LLAMA_REST} || {closing} AS {name}"""


ORACLES["chatml_llama3_text"] = f"SELECT conv_id, piece, {llama_chat()} FROM {ORDERED_PARTS} GROUP BY conv_id, piece"
ORACLES["chatml_llama3_pieces"] = f"SELECT conv_id, piece, {llama_chat()} FROM {ordered_parts(3)} GROUP BY conv_id, piece"

ASKED = "'And chat ' || conv_id || '? '"
PROMPT_END = f"{header(lit('user'))} || {strip(ASKED)} || {EOT} || {header(lit('assistant'))}"


def prompts(source: str) -> str:
    at_end = "max(turn) = any_value(last)"
    return f"""
SELECT conv_id, piece, {llama_chat(f"CASE WHEN {at_end} THEN {PROMPT_END} ELSE '' END", "prompt")},
       string_agg(text, {NL} ORDER BY turn) || {NL} || CASE WHEN {at_end} THEN {ASKED} ELSE '' END AS bare_prompt
FROM {source} GROUP BY conv_id, piece"""


ORACLES["chat_prompt_text"], ORACLES["chat_prompt_pieces"] = prompts(ORDERED_PARTS), prompts(ordered_parts(3))

TOOL_TEXT = chat.TOOLS_IN_USER + chat.TOOLS_FORMAT + "".join(json.dumps(t, indent=4) + "\n\n" for t in TOOLS)
# with tools, the first message after the system one is the user message the tools are put into
ORACLES["chat_llama3_tools_text"] = f"""
WITH t AS (SELECT *, piece = 0 AND role = 'system' AND turn = first_turn AS is_system FROM {ORDERED_PARTS}),
     n AS (SELECT *, CASE WHEN NOT is_system THEN row_number() OVER (PARTITION BY conv_id, is_system ORDER BY turn) END AS k FROM t)
SELECT conv_id, piece,
       CASE WHEN piece = 0 THEN {opening(chat.TOOLS_ENVIRONMENT)}
       || {header(lit("user"))} || {lit(TOOL_TEXT)}
       || max(CASE WHEN k = 1 THEN {strip("text")} END) || {EOT} ELSE '' END
       || coalesce(string_agg(CASE WHEN k > 1 THEN {LLAMA_TURN} END, '' ORDER BY turn), '') AS text
FROM n GROUP BY conv_id, piece"""

EXCHANGES = """(SELECT u.conv_id, u.turn, u.text AS instruction, coalesce(s.text, '') AS input, a.text AS output
    FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system'
    WHERE u.role = 'user')"""


def exchange_text(user: str) -> str:
    return f"""SELECT conv_id, turn, '<|user|>' || {NL} || {user} || {NL} || '<|assistant|>' || {NL} || output || {NL} AS text
    FROM {EXCHANGES}"""


ORACLES["alpaca_sft_text"] = exchange_text(
    f"instruction || CASE WHEN length(input) > 0 THEN {NL} || {NL} || input ELSE '' END"
)
ORACLES["prompt_completion_sft_text"] = exchange_text("instruction")
ORACLES["text_sft_rows"] = ORACLES["text_cpt_rows"] = "SELECT doc_id, text FROM documents"

PREFERENCES = """
WITH k AS (SELECT lang, source, quality, text, row_number() OVER (PARTITION BY lang, source, quality ORDER BY doc_id) - 1 AS i,
                  count(*) OVER (PARTITION BY lang, source, quality) AS n FROM documents JOIN labels USING (doc_id)),
     g AS (SELECT * FROM k WHERE quality = 1), b AS (SELECT * FROM k WHERE quality = 0)
SELECT g.lang, greatest(g.i, b.i) AS pair, {chosen} AS chosen, {rejected} AS rejected, {prompt}
FROM g JOIN b ON g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source
  AND CASE WHEN g.n >= b.n THEN b.i = g.i % b.n ELSE g.i = b.i % g.n END"""
TEXTS = {"chosen": "g.text", "rejected": "b.text"}
DIGESTS = {"chosen": "md5(g.text)", "rejected": "md5(b.text)"}
ORACLES["preference_dpo_rows"] = PREFERENCES.format(prompt="g.source AS prompt", **TEXTS)
ORACLES["preference_orpo_rows_without_prompt"] = PREFERENCES.format(prompt="g.source AS source, '' AS prompt", **TEXTS)
ORACLES["preference_simpo_rows"] = PREFERENCES.format(prompt="g.source AS prompt", **DIGESTS)
ORACLES["kto_rows"] = """SELECT doc_id, source AS prompt, text AS completion, quality <> 0 AS label
    FROM documents JOIN labels USING (doc_id)"""
ORACLES["grpo_rows"] = "SELECT item_id, text AS prompt FROM benchmark"
ORACLES["embedding_rows"] = (
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS anchor, url AS positive FROM pages"
)
ORACLES["audio_tts_rows"] = ORACLES["audio_stt_rows"] = (
    "SELECT doc_id, 'clip' || doc_id || '.wav' AS audio, text FROM documents"
)
ORACLES["image_ocr_rows"] = "SELECT doc_id, 'scan' || doc_id || '.png' AS image, text FROM documents"
ORACLES["vision_chat_rows"] = f"""
SELECT conv_id, piece, 'img' || conv_id || '.png' AS images,
       string_agg(CASE role WHEN 'system' THEN 'user' ELSE role END || ':' || text, '|' ORDER BY turn) AS messages
FROM {PARTS} GROUP BY conv_id, piece"""
ORACLES["kto_field_quality"] = """
WITH r AS (SELECT nullif(source, 'src0') AS prompt, text AS completion FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'prompt' AS field, count(*) AS n_rows, count(*) FILTER (prompt IS NULL) AS n_null, count(*) FILTER (prompt = '') AS n_empty FROM r
UNION ALL SELECT 'completion', count(*), count(*) FILTER (completion IS NULL), count(*) FILTER (completion = '') FROM r
UNION ALL SELECT 'label', count(*), 0, 0 FROM r"""

# --- detection ----------------------------------------------------------------------------------
LAYOUT_ROWS = ", ".join(
    f"({n}, {i}, {lit(c)}, {lit(s)})" for n, layout in enumerate(A.LAYOUTS) for i, (c, s) in enumerate(layout)
)
SYNONYM_ROWS = ", ".join(
    f"({lit(c)}, {lit(w)}, {rank})" for c, words in dims.SYNONYMS.items() for rank, w in enumerate(dict.fromkeys((c, *words)))
)
HEADERS = f"""SELECT doc_id AS dataset, l.pos, l.name, l.sample, lower({strip("l.name")}) AS header_key
    FROM documents JOIN (VALUES {LAYOUT_ROWS}) l(n, pos, name, sample) ON l.n = doc_id % {len(A.LAYOUTS)}"""


def _picks() -> str:
    return ",\n".join(
        f"max(name) FILTER (canonical = '{c}') AS c_{c}, max(sample) FILTER (canonical = '{c}') AS s_{c}" for c in dims.SYNONYMS
    )


MEDIA = "(s_image LIKE '%.PNG' OR s_image NOT LIKE 't:%')"
MAPPED = {  # rule -> mapping as text, keys in alphabetical order
    "R1": "'images=' || c_image || ';messages=' || c_conversations",
    "R2": "'image=' || c_image || ';text=' || c_text",
    "R3": "'audio=' || c_audio || ';text=' || c_transcription",
    "R4": "'conversations=' || c_conversations",
    "R5": "'messages=' || c_conversations",
    "R6": "'chosen=' || c_chosen || ';prompt=' || c_prompt || ';rejected=' || c_rejected",
    "R7": "'chosen=' || c_chosen || ';rejected=' || c_rejected",
    "R8": "'completion=' || c_completion || ';label=' || c_label || ';prompt=' || c_prompt",
    "R9": "coalesce('input=' || c_input || ';', '') || 'instruction=' || c_instruction || ';output=' || c_output",
    "R10": "'completion=' || c_completion || ';prompt=' || c_prompt",
    "R11": "'anchor=' || c_anchor || ';positive=' || c_positive",
    "R12": "'prompt=' || c_prompt",
    "R13": "'text=' || c_text",
    "R14": "'text=' || text_column",
    "R15": "''",
}
RULE_SQL = (
    ("R1", "vision_chat", "c_image IS NOT NULL AND c_conversations IS NOT NULL", f"CASE WHEN {MEDIA} THEN 0.9 ELSE 0.6 END"),
    ("R2", "image_text", "c_image IS NOT NULL AND c_text IS NOT NULL", f"CASE WHEN {MEDIA} THEN 0.85 ELSE 0.55 END"),
    ("R3", "audio_text", "c_transcription IS NOT NULL AND (s_audio LIKE '%.wav' OR s_audio = 'object')", "0.9"),
    ("R4", "sharegpt", "s_conversations = 'from_value_turns'", "0.95"),
    ("R5", "chatml", "s_conversations = 'role_content_turns'", "0.95"),
    ("R6", "preference", "c_chosen IS NOT NULL AND c_rejected IS NOT NULL AND c_prompt IS NOT NULL", "0.95"),
    ("R7", "preference", "c_chosen IS NOT NULL AND c_rejected IS NOT NULL", "0.75"),
    ("R8", "kto", "c_prompt IS NOT NULL AND c_completion IS NOT NULL AND s_label IN ('int', 'bool')", "0.9"),
    ("R9", "alpaca", "c_instruction IS NOT NULL AND c_output IS NOT NULL", "0.95"),
    ("R10", "prompt_completion", "c_prompt IS NOT NULL AND c_completion IS NOT NULL", "0.9"),
    ("R11", "embedding_pairs", "c_anchor <> c_positive", "0.8"),
    ("R12", "grpo", "c_prompt IS NOT NULL AND n_columns <= 2", "0.6"),
    ("R13", "text", "c_text IS NOT NULL", "0.85"),
    ("R14", "text", "n_texts = 1", "0.5"),
    ("R15", "unknown", "true", "0.0"),
)


def _case(column: int) -> str:
    def value(rule):
        return {0: f"'{rule[0]}'", 1: f"'{rule[1]}'", 3: f"CAST({rule[3]} AS DOUBLE)", 4: MAPPED[rule[0]]}[column]

    return "CASE " + " ".join(f"WHEN {r[2]} THEN {value(r)}" for r in RULE_SQL) + " END"


VERDICTS = f"""
WITH syn(canonical, word, rank) AS (VALUES {SYNONYM_ROWS}),
     h AS ({HEADERS}),
     hits AS (SELECT dataset, canonical, name, sample,
                     row_number() OVER (PARTITION BY dataset, canonical ORDER BY rank, pos DESC) AS rn
              FROM h JOIN syn ON word = header_key),
     picks AS (SELECT dataset, {_picks()} FROM hits WHERE rn = 1 GROUP BY dataset),
     n AS (SELECT dataset, count(*) AS n_columns, count(*) FILTER (sample LIKE 't:%') AS n_texts,
                  min(name) FILTER (sample LIKE 't:%') AS text_column FROM h GROUP BY dataset),
     v AS (SELECT dataset, {_case(0)} AS rule, {_case(1)} AS format, {_case(3)} AS confidence, {_case(4)} AS mapping
           FROM n LEFT JOIN picks USING (dataset))
"""
# fields set by hand: text and label are looked up beside the column that image was given
SET_BY_HAND = VERDICTS.replace(
    "FROM h JOIN syn ON word = header_key),",
    """FROM (SELECT dataset, canonical, name, sample, rank, pos FROM h JOIN syn ON word = header_key
                UNION ALL SELECT dataset, 'image', name, sample, -1, pos FROM h WHERE name = 'text'
                UNION ALL SELECT dataset, 'label', name, sample, -1, pos FROM h WHERE name = 'score'
                UNION ALL SELECT dataset, 'text_beside', name, sample, rank, pos FROM h JOIN syn ON word = header_key
                    WHERE canonical = 'text' AND name <> 'text')),""",
).replace(
    "picks AS (SELECT dataset,", "picks AS (SELECT dataset, max(name) FILTER (canonical = 'text_beside') AS c_beside,"
)
BESIDE = "(CASE WHEN c_text = c_image THEN c_beside ELSE c_text END)"
SET_BY_HAND = SET_BY_HAND.replace("c_image IS NOT NULL AND c_text IS NOT NULL", f"c_image IS NOT NULL AND {BESIDE} IS NOT NULL").replace(
    "|| ';text=' || c_text THEN", f"|| ';text=' || {BESIDE} THEN"
)
SET_BY_HAND = SET_BY_HAND.replace("'image=' || c_image || ';text=' || c_text", f"'image=' || c_image || ';text=' || {BESIDE}")
ORACLES["detect_with_overrides"] = SET_BY_HAND + "SELECT dataset, rule, format, confidence, mapping FROM v"
ORACLES["detect_catalog"] = VERDICTS + "SELECT dataset, rule, format, confidence, mapping FROM v"
LABEL_ROWS = ", ".join(f"({lit(f)}, {lit(label)})" for f, label in dims.FORMAT_LABELS.items())
ORACLES["detected_labels"] = VERDICTS + f"""
SELECT format, coalesce(label, format) AS format_label, count(*) AS n_datasets
FROM v LEFT JOIN (VALUES {LABEL_ROWS}) l(f, label) ON f = format GROUP BY ALL"""
TASK_ROWS = ", ".join(
    f"({i}, {lit(t.id)}, {lit(t.label)}, {lit(f)})" for i, t in enumerate(dims.TASKS) for f in t.detector_formats
)
ORACLES["compatible_tasks"] = VERDICTS + f"""
SELECT task, label AS task_label, CAST(i AS INTEGER) AS position, count(*) AS n_datasets
FROM v JOIN (VALUES {TASK_ROWS}) t(i, task, label, f) ON f = format GROUP BY ALL"""
ORACLES["normalized_headers"] = f"""
SELECT header_key AS header, name AS "column"
FROM (SELECT *, row_number() OVER (PARTITION BY header_key ORDER BY pos DESC) AS rn FROM ({HEADERS}))
WHERE rn = 1"""
ORACLES["ragged_census"] = """
WITH k AS (SELECT doc_id, [ '["text"]', '["completion","label","prompt"]', '["lang","text"]', '["instruction","output"]',
                           '["messages"]' ][doc_id % 5 + 1] AS key_set FROM documents),
     d(key_set, format, confidence, mapping) AS (VALUES
        ('["text"]', 'text', 0.85, 'text=text'),
        ('["completion","label","prompt"]', 'kto', 0.9, 'completion=completion;label=label;prompt=prompt'),
        ('["lang","text"]', 'text', 0.85, 'text=text'),
        ('["instruction","output"]', 'alpaca', 0.95, 'instruction=instruction;output=output'),
        ('["messages"]', 'chatml', 0.95, 'messages=messages'))
SELECT key_set, count(*) AS n_rows, min(doc_id) AS first_row, format, CAST(confidence AS DOUBLE) AS confidence, mapping
FROM k JOIN d USING (key_set) GROUP BY ALL"""


def _evidence() -> str:
    def text_tests(c: str) -> dict[str, str]:
        path = f"regexp_matches(lower({c}), '[.](png|jpg|jpeg|webp|bmp|tiff)$')"
        return {
            "null": f"{c} IS NULL",
            "string": f"{c} IS NOT NULL",
            "media": f"{c} IS NULL OR {path}",
            "audio": f"regexp_matches(lower({c}), '[.](wav|mp3|flac|m4a|ogg)$')",
            "from_value_turns": "false", "role_content_turns": "false", "flag": "false",
        }

    tests = {
        "image": text_tests("image"),
        "text": text_tests("text"),
        "label": {
            "null": "label IS NULL", "string": "false", "media": "true", "audio": "false",
            "from_value_turns": "false", "role_content_turns": "false", "flag": "label IS NOT NULL",
        },
    }
    rows = [
        f"""SELECT '{c}' AS "column", '{t}' AS test, count(*) AS n_rows, count(*) FILTER ({test}) AS n_pass,
            CAST(count(*) FILTER ({test}) AS DOUBLE) / count(*) AS share FROM m"""
        for c, by_test in tests.items()
        for t, test in by_test.items()
    ]
    return (
        "WITH m AS (SELECT CASE WHEN lang = 'en' THEN source || '.png' WHEN lang <> 'fr' THEN source END AS image,"
        " quality AS label, text FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(rows)
    )


ORACLES["detection_evidence"] = _evidence()
ORACLES["detect_and_ingest"] = f"""
SELECT count(*) AS n_rows, count(*) AS n_ingested, 'chatml' AS format, CAST(0.95 AS DOUBLE) AS confidence,
       'messages ← messages' AS mapping, {lit(dims.TASK_BY_ID["sft"].label)} AS tasks
FROM (SELECT DISTINCT conv_id FROM {PARTS})"""
ORACLES["dataset_preview"] = """
SELECT doc_id, left(text, 300) AS text, left(lang, 300) AS lang, left(source, 300) AS source, n_chars
FROM documents ORDER BY doc_id LIMIT 8"""

# --- sources --------------------------------------------------------------------------------------
for _name in ("scan_jsonl", "scan_json_list", "scan_json_wrapper", "scan_csv", "scan_csv_ranges", "scan_tsv", "scan_parquet"):
    ORACLES[_name] = "SELECT doc_id, lang, md5(text) AS digest FROM documents"
BUCKET = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"
ORACLES["scan_split"] = f"SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE {BUCKET} < 20"
ORACLES["training_set_sink"] = """
SELECT doc_id, source AS prompt, md5(text) AS digest, quality <> 0 AS label FROM documents JOIN labels USING (doc_id)"""
ORACLES["capped_scan"] = "SELECT event_id, event_type FROM events LIMIT 700"  # files keep their order
ORACLES["capped_rows"] = "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500"
ORACLES["nonblank_lines"] = f"""
SELECT doc_id, count(*) AS n_lines
FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line FROM documents)
WHERE length({strip("line")}) > 0 GROUP BY doc_id"""

# --- logs -------------------------------------------------------------------------------------------
LINES = """(SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type
    WHEN 'click' THEN 'step ' || event_id % 1000 || ': loss ' || value
    WHEN 'view' THEN '12/100 | Loss= ' || value
    WHEN 'signup' THEN '{''loss'': ' || value || ', ''step'': ' || event_id % 1000 || '}'
    WHEN 'error' THEN 'step ' || event_id % 1000 || ': loss nan, was -' || value
    ELSE 'saving state ' || event_id % 1000 END AS line FROM events)"""
CHUNKS = f"""(SELECT job_id, CASE WHEN seq // 2 % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS channel, seq,
    CASE WHEN seq % 5 = 0 THEN line
         WHEN seq % 5 = 1 THEN line[1:3] || chr(13) || line || {NL} || '  ' || {NL} || line[1:4]
         ELSE line[1:5] || {NL} || line[6:] END AS chunk FROM {LINES})"""
RELINED = f"""
WITH whole AS (SELECT job_id, channel, string_split_regex(string_agg(chunk, '' ORDER BY seq), '[\\n\\r]') AS parts
               FROM {CHUNKS} GROUP BY job_id, channel),
     cut AS (SELECT job_id, channel, unnest(parts[1:len(parts) - 1]) AS line,
                    unnest(range(len(parts) - 1)) AS line_no FROM whole WHERE len(parts) > 1)
SELECT job_id, channel, line_no, line FROM cut WHERE length({strip("line")}) > 0"""
ORACLES["log_relines"] = ORACLES["streamed_lines"] = RELINED

POINTS = f"""(SELECT * FROM (SELECT job_id, seq,
    TRY_CAST(nullif(regexp_extract(line, {lit(L.STEP)}, 1), '') AS BIGINT) AS explicit_step,
    TRY_CAST(nullif(regexp_extract(line, {lit(L.LOSS)}, 1), '') AS DOUBLE) AS loss FROM {LINES}) WHERE loss IS NOT NULL)"""
SERIES = f"""(SELECT job_id, seq, loss,
    coalesce(max(explicit_step) OVER g, 0)
      + CAST(sum(CASE WHEN explicit_step IS NULL THEN 1 ELSE 0 END) OVER (g ORDER BY seq) AS BIGINT) AS step
    FROM (SELECT *, count(explicit_step) OVER (PARTITION BY job_id ORDER BY seq) AS run FROM {POINTS})
    WINDOW g AS (PARTITION BY job_id, run))"""
SERIES = SERIES.replace("OVER (g ORDER BY seq)", "OVER (PARTITION BY job_id, run ORDER BY seq)")
ORACLES["log_loss_points"] = f"SELECT job_id, seq, coalesce(explicit_step, -1) AS explicit_step, loss FROM {POINTS}"
ORACLES["log_loss_series"] = ORACLES["streamed_loss_series"] = f"SELECT job_id, seq, step, loss FROM {SERIES}"
ORACLES["log_points_per_job"] = f"SELECT job_id, count(*) AS n_points FROM {POINTS} GROUP BY job_id"
FIRST_LAST = f"""SELECT job_id, arg_min(step, seq) AS first_step, arg_min(loss, seq) AS first_loss,
    arg_max(step, seq) AS last_step, arg_max(loss, seq) AS last_loss FROM {SERIES} GROUP BY job_id"""
ORACLES["log_first_and_last"] = FIRST_LAST
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS r FROM {POINTS})"
ORACLES["log_every_kth_point"] = f"SELECT job_id, seq, r // 4 AS kth, loss FROM {NUMBERED} WHERE r % 4 = 0"
ORACLES["log_loss_trajectory"] = f"""
SELECT job_id, r // 4000 AS piece, string_agg(printf('%.3f', loss), ' → ' ORDER BY seq) AS trajectory
FROM {NUMBERED} WHERE r % 4 = 0 GROUP BY ALL"""


def last_lines(n: int, source: str = LINES) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= {n})"


ORACLES["log_ring"] = f"SELECT job_id, seq, line FROM {last_lines(50)}"
ORACLES["log_ring_whole"] = f"SELECT job_id, seq, md5(line) AS digest FROM {last_lines(L.RING_LINES)}"
ORACLES["log_tails"] = f"""
SELECT job_id, string_agg(line, {NL} ORDER BY seq) AS tail, count(*) AS n_lines FROM {last_lines(20)} GROUP BY job_id"""

KINDS = """(SELECT user_id AS job_id, ts, props, CASE
    WHEN event_type = 'view' THEN 'started'
    WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'stop_requested'
    WHEN event_type = 'purchase' AND user_id % 4 <> 0 THEN 'returned'
    WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'failed'
    ELSE 'submitted' END AS kind FROM events)"""
STATUS = f"""(SELECT job_id, error, failed, CASE
        WHEN failed IS NOT NULL THEN 'failed'
        WHEN returned IS NOT NULL AND stopped <= returned THEN 'stopped'
        WHEN returned IS NOT NULL THEN 'finished'
        WHEN started IS NOT NULL THEN 'running' ELSE 'pending' END AS status,
    round(coalesce((epoch_us(coalesce(failed, returned, TIMESTAMP '{A.AS_OF}')) - epoch_us(started)) / 1e6, 0.0), 3) AS elapsed
    FROM (SELECT job_id, min(ts) FILTER (kind = 'started') AS started, min(ts) FILTER (kind = 'stop_requested') AS stopped,
                 max(ts) FILTER (kind = 'returned') AS returned, max(ts) FILTER (kind = 'failed') AS failed,
                 arg_max('ZeroDivisionError: loss 7.5 in ' || props, ts) FILTER (kind = 'failed') AS error
          FROM {KINDS} GROUP BY job_id))"""
ORACLES["job_statuses"] = f"SELECT job_id, status, elapsed, error FROM {STATUS}"
JOBS = "(SELECT user_id AS job_id, 'sft · model-' || min(event_id) AS name FROM events GROUP BY user_id)"
WITH_ERRORS = f"""(SELECT job_id, seq, line FROM {LINES} UNION ALL
    SELECT job_id, last + 1, error FROM {STATUS} JOIN (SELECT job_id, max(seq) AS last FROM {LINES} GROUP BY job_id) USING (job_id)
    WHERE failed IS NOT NULL)"""
WITH_STOPS = f"""(SELECT job_id, seq * 2 AS seq, line FROM {WITH_ERRORS} UNION ALL
    SELECT user_id, event_id * 2 + 1, {lit(L.STOP_LINE)} FROM events WHERE event_type = 'click' AND user_id % 3 = 0)"""
ORACLES["job_series"] = f"SELECT job_id, step, loss FROM {SERIES.replace(LINES, WITH_ERRORS)}"
ORACLES["newest_job_series"] = ORACLES["job_series"] + " WHERE job_id = (SELECT max(user_id) FROM events)"
SNAPSHOTS = f"""
SELECT j.job_id, j.name, s.status, s.elapsed, coalesce(p.n, 0) AS n_points, t.tail
FROM {JOBS} j JOIN {STATUS} s USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n FROM {WITH_ERRORS} WHERE regexp_matches(line, {lit(L.LOSS)}) GROUP BY job_id) p USING (job_id)
JOIN (SELECT job_id, string_agg(line, {NL} ORDER BY seq) AS tail FROM {last_lines(5, WITH_STOPS)} GROUP BY job_id) t USING (job_id)"""
ORACLES["job_snapshots"] = SNAPSHOTS
ORACLES["newest_job_snapshot"] = SNAPSHOTS + " WHERE j.job_id = (SELECT max(user_id) FROM events)"
ICON_ROWS = ", ".join(f"({lit(s)}, {lit(i)})" for s, i in dims.STATUS_ICONS.items())
ORACLES["job_listing"] = f"""
SELECT job_id, status, '#' || job_id || ' ' || icon || ' ' || name AS entry
FROM {JOBS} JOIN {STATUS} USING (job_id) JOIN (VALUES {ICON_ROWS}) i(s, icon) ON s = status"""
ORACLES["run_history"] = f"SELECT job_id, status FROM {STATUS}"

TRAINER = """(SELECT user_id AS job_id, event_id AS seq, event_type, event_id % 20 AS n, CAST(value AS VARCHAR) AS x FROM events)"""
ORACLES["log_pattern_hits"] = f"""
WITH t AS (SELECT * FROM {TRAINER})
SELECT job_id, seq, 'val_loss' AS kind, 0::BIGINT AS pos, (-1)::BIGINT AS iter, x AS value FROM t WHERE event_type = 'view'
UNION ALL SELECT job_id, seq, 'iter_val_loss', 0, n, x FROM t WHERE event_type = 'view'
UNION ALL SELECT job_id, seq, 'iter_train_loss', 0, n, x FROM t WHERE event_type = 'click'
UNION ALL SELECT job_id, seq, 'tokens_per_second', 0, -1, x FROM t WHERE event_type = 'click'
UNION ALL SELECT job_id, seq, 'iter_saved', 0, n, '' FROM t WHERE event_type = 'purchase'
UNION ALL SELECT job_id, seq, 'peak_memory', 0, -1, x FROM t WHERE event_type = 'signup'
UNION ALL SELECT job_id, seq, 'peak_memory', 1, -1, '9.5' FROM t WHERE event_type = 'signup'"""
ORACLES["log_headlines"] = f"""
WITH t AS (SELECT * FROM {TRAINER})
SELECT job_id,
       coalesce(arg_min(x, seq) FILTER (event_type = 'view'), '—') AS val_first,
       coalesce(arg_max(x, seq) FILTER (event_type = 'view'), '—') AS val_last,
       coalesce(CAST(CAST(round_even(CAST(arg_max(x, seq) FILTER (event_type = 'click') AS DOUBLE), 0) AS BIGINT) AS VARCHAR), '—') AS tps,
       coalesce(CASE WHEN max(CAST(x AS DOUBLE)) FILTER (event_type = 'signup') >= 9.5
                     THEN arg_max(x, CAST(x AS DOUBLE)) FILTER (event_type = 'signup')
                     WHEN bool_or(event_type = 'signup') THEN '9.5' END, '—') AS mem
FROM t GROUP BY job_id"""
ORACLES["checkpoint_table"] = f"""
WITH t AS (SELECT * FROM {TRAINER}),
     l AS (SELECT job_id, n, arg_max(x, seq) FILTER (event_type = 'view') AS val, arg_max(x, seq) FILTER (event_type = 'click') AS train
           FROM t GROUP BY job_id, n)
SELECT t.job_id, t.n AS iter, printf('%07d_adapters.safetensors', t.n) AS checkpoint,
       coalesce(val, '—') AS val_loss, coalesce(train, '—') AS train_loss
FROM t LEFT JOIN l ON l.job_id = t.job_id AND l.n = t.n WHERE event_type = 'purchase'"""
ORACLES["eval_loss_series"] = f"""
SELECT job_id, seq, CASE event_type WHEN 'view' THEN 'val' ELSE 'train' END AS kind, n AS step, CAST(x AS DOUBLE) AS loss
FROM {TRAINER} WHERE event_type IN ('view', 'click')"""
DAY = 86_400_000_000


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


ORACLES["log_stalls"] = f"""
WITH g AS (SELECT job_id, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS nxt FROM {LINES}),
     q AS (SELECT *, epoch_us(coalesce(nxt, TIMESTAMP '{A.AS_OF}')) - epoch_us(ts) AS quiet FROM g)
SELECT job_id, {stamp("ts")} AS last_line_at, coalesce({stamp("nxt")}, '') AS next_line_at, round(quiet / 1e6, 3) AS quiet
FROM q WHERE quiet > {DAY}"""
# a session is out once the latest line of all is a whole gap past its own last line
ORACLES["streamed_stalls"] = f"""
WITH g AS (SELECT job_id, ts, epoch_us(ts) AS t, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ts)) AS gap FROM {LINES}),
     s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > {DAY}) OVER (PARTITION BY job_id ORDER BY t) AS session FROM g)
SELECT job_id, {stamp("min(ts)")} AS active_from, {stamp("max(ts)")} AS last_line_at, count(*) AS n_lines FROM s GROUP BY job_id, session"""

# --- runs -------------------------------------------------------------------------------------------
TASK_LIST = "[" + ", ".join(f"'{t.id}'" for t in dims.TASKS) + ", 'no_such_task']"
RUNS = f"""(SELECT p_partkey AS run_id, ({TASK_LIST})[p_partkey % {len(dims.TASKS) + 1} + 1] AS task, 'org/' || p_brand AS model_name,
    p_retailprice / 1000000 AS learning_rate, p_size AS batch_size,
    CASE WHEN p_size % 3 = 0 THEN p_size / 10 END AS num_train_epochs, p_size % 2 = 0 AS gradient_checkpointing,
    CASE WHEN p_size % 5 = 0 THEN p_name END AS note, p_size, p_name, p_brand, p_retailprice FROM part)"""
ORACLES["parsed_configs"] = f"""
SELECT run_id, task, model_name, learning_rate, batch_size, num_train_epochs, gradient_checkpointing,
       100 AS max_steps, 42 AS seed, coalesce('beta=0.3;note=' || note, '') AS extra FROM {RUNS}"""
ORACLES["config_round_trip"] = "SELECT p_partkey AS run_id, true AS same, 'q_proj,k_proj,v_proj,o_proj' AS target_modules FROM part"
BETA_IN = ", ".join(f"'{t}'" for t in BETA_TASKS)
ORACLES["form_configs"] = f"""
SELECT run_id, task, 'out/' || p_brand AS output_dir, p_size AS batch_size, 4 AS gradient_accumulation_steps,
       learning_rate, CAST(run_id AS INTEGER) AS max_steps, CAST(nullif(p_size % 4, 0) AS DOUBLE) AS num_train_epochs,
       p_size % 2 = 1 AS gradient_checkpointing, 42 AS seed,
       CASE WHEN task IN ({BETA_IN}) AND p_size % 3 <> 0 THEN 'beta=' || CAST((p_size % 3) / 10 AS VARCHAR) ELSE '' END AS extra
FROM {RUNS}"""
DEFAULT_ROWS = ", ".join(f"({lit(t.id)}, {lit(k)}, {lit(v)})" for t in dims.TASKS for k, v in t.defaults.items())
ARGS = f"""
WITH r AS (SELECT * FROM {RUNS} WHERE task <> 'no_such_task'),
     a AS (SELECT run_id, 'output_dir' AS arg, 'outputs' AS v, 0 AS pr FROM r
           UNION ALL SELECT run_id, 'per_device_train_batch_size', CAST(batch_size AS VARCHAR), 0 FROM r
           UNION ALL SELECT run_id, 'gradient_accumulation_steps', '1', 0 FROM r
           UNION ALL SELECT run_id, 'learning_rate', CAST(learning_rate AS VARCHAR), 0 FROM r
           UNION ALL SELECT run_id, 'warmup_steps', '5', 0 FROM r
           UNION ALL SELECT run_id, 'seed', '42', 0 FROM r
           UNION ALL SELECT run_id, 'num_train_epochs', CAST(num_train_epochs AS VARCHAR), 0 FROM r WHERE num_train_epochs <> 0
           UNION ALL SELECT run_id, 'max_steps', '100', 0 FROM r WHERE coalesce(num_train_epochs, 0) = 0
           UNION ALL SELECT run_id, 'gradient_checkpointing', 'true', 0 FROM r WHERE gradient_checkpointing
           UNION ALL SELECT run_id, d.k, d.v, 1 FROM r JOIN (VALUES {DEFAULT_ROWS}) d(t, k, v) ON d.t = r.task
           UNION ALL SELECT run_id, 'beta', '0.3', 2 FROM r WHERE note IS NOT NULL
           UNION ALL SELECT run_id, 'note', note, 2 FROM r WHERE note IS NOT NULL),
     w AS (SELECT run_id, arg, v FROM a QUALIFY row_number() OVER (PARTITION BY run_id, arg ORDER BY pr DESC) = 1)
SELECT run_id, arg, TRY_CAST(v AS DOUBLE) AS number, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS text, NULL AS refused FROM w"""
REFUSED = f"""
UNION ALL SELECT run_id, NULL, NULL, NULL, 'Unknown task: ' || task FROM {RUNS} WHERE task = 'no_such_task'"""
ORACLES["trainer_arguments"] = ARGS + REFUSED
ORACLES["accepted_arguments"] = ARGS + " WHERE run_id % 2 = 1 OR arg IN ('learning_rate', 'seed', 'beta')" + REFUSED
CARD_ROWS = ", ".join(
    f"({lit(t.id)}, {lit(t.label)}, {lit(t.trainer)}, {lit(t.config)}, {lit(', '.join(t.dataset_schema))}, {lit(t.notes)})"
    for t in dims.TASKS
)
ORACLES["task_cards"] = f"""
SELECT c.*, coalesce(n, 0) AS n_runs
FROM (VALUES {CARD_ROWS}) c(task, task_label, trainer, config, dataset_schema, notes)
LEFT JOIN (SELECT task, count(*) AS n FROM {RUNS} GROUP BY task) r ON r.task = c.task"""
ORACLES["parsed_recipes"] = f"""
SELECT run_id, task, p_size AS lora_r, p_retailprice / 1000 AS learning_rate, 2 AS batch_size, 'q_proj,v_proj' AS target_modules,
       CASE WHEN run_id % 4 <> 0 THEN 'org/' || replace(p_name, ' ', '-') ELSE '' END AS source,
       run_id % 4 <> 0 AND p_size % 2 = 0 AS is_local FROM {RUNS}"""
ORACLES["saved_recipes"] = f"""
SELECT CASE WHEN run_id % 3 = 0 THEN 'my-run-' || run_id
            ELSE task || '-' || strftime(TIMESTAMP '2024-05-06 07:08:09' + to_seconds(run_id), '%Y%m%d-%H%M%S') END AS slug,
       task, learning_rate, 'org/data' AS source, run_id % 2 = 0 AS is_local FROM {RUNS}"""
ORACLES["sweep_variants"] = f"""
SELECT run_id, CAST(i * 6 + j * 2 + k AS INTEGER) AS variant, task, lr AS learning_rate, CAST(r AS INTEGER) AS lora_r,
       CAST(s AS INTEGER) AS max_steps, batch_size
FROM {RUNS}, (VALUES (0, 1e-4), (1, 2e-4)) a(i, lr), (VALUES (0, 8), (1, 16), (2, 32)) b(j, r), (VALUES (0, 50), (1, 100)) c(k, s)"""
ORACLES["sweep_comparison"] = f"""
SELECT run_id AS job_id, learning_rate, 16 AS lora_r, coalesce(last_step, -1) AS last_step, coalesce(last_loss, -1.0) AS last_loss
FROM {RUNS} LEFT JOIN ({FIRST_LAST}) f ON f.job_id = run_id"""

# --- catalogs ------------------------------------------------------------------------------------------
CATALOG = "(SELECT p_name AS id, p_partkey AS entry, CAST(floor(p_retailprice) AS BIGINT) AS downloads, p_type, p_brand FROM part)"


def search(words: str, where: str = "true") -> str:
    return f"""SELECT id, entry, downloads FROM {CATALOG} WHERE contains(lower(id), '{words}') AND {where}
    ORDER BY downloads DESC, entry LIMIT 20"""


ORACLES["dataset_search"] = search("red")
ORACLES["model_search_tagged"] = search("ring", "'ECONOMY' IN (p_type, p_brand)")
ORACLES["model_search_fallback"] = search("ring")
MANIFEST = """(SELECT 'm' || page_id % 9 AS artifact, CASE
    WHEN page_id // 9 % 27 = 1 AND page_id % 3 = 0 THEN 'readme.md'
    WHEN page_id // 9 % 27 >= 3 THEN printf('adapters/%07d_adapters.safetensors', page_id // 9 % 27 * 100)
    ELSE (['model.safetensors', 'config.json', 'tokenizer.json'])[page_id // 9 % 27 + 1] END AS path FROM pages)"""
ORACLES["artifact_completeness"] = f"""
WITH m AS (SELECT DISTINCT artifact, path FROM {MANIFEST}),
     need(i, file) AS (VALUES (0, 'model.safetensors'), (1, 'config.json'), (2, 'tokenizer.json')),
     a AS (SELECT artifact, count(*) FILTER (path LIKE 'adapters/%.safetensors') AS n_checkpoints FROM m GROUP BY artifact),
     gone AS (SELECT a.artifact, string_agg(file, ',' ORDER BY i) AS missing FROM a CROSS JOIN need
              WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.artifact = a.artifact AND m.path = need.file) GROUP BY a.artifact)
SELECT artifact, coalesce(missing, '') AS missing, n_checkpoints, missing IS NULL AND n_checkpoints >= 21 AS complete
FROM a LEFT JOIN gone USING (artifact)"""
ORACLES["model_directories"] = f"SELECT artifact, bool_or(path = 'config.json') AS is_model FROM {MANIFEST} GROUP BY artifact"

# --- statistics ------------------------------------------------------------------------------------------
ORACLES["validation_split"] = f"SELECT doc_id, CASE WHEN {BUCKET} < 10 THEN 'validation' ELSE 'train' END AS split FROM documents"
ORACLES["length_histogram"] = """
SELECT len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) // 50 * 50 AS bucket_start, count(*) AS n_rows FROM documents GROUP BY 1"""
ORACLES["duplicate_texts"] = """
SELECT sha256(text) AS text_sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1"""
ORACLES["multi_positive_pairs"] = f"""
WITH p AS (SELECT doc_id, source, lang, string_split(text, {NL}) AS lines FROM documents),
     e AS (SELECT doc_id, source AS anchor, [lang, source] AS negatives, unnest(lines) AS positive,
                  unnest(range(1, len(lines) + 1)) AS i FROM p)
SELECT doc_id, anchor, positive, negatives[i] AS negative FROM e"""
