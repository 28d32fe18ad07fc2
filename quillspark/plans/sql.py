"""Pieces of the SQL that checks the queries."""

from __future__ import annotations

BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
QUOTES = "\"''`‘’‚‛“”„‟«»‹›「」"


def norm(text: str, form: bool = True, ascii_punctuation: bool = False, ascii_only: bool = False) -> str:
    out = f"nfc_normalize({text})" if form else text
    if ascii_punctuation:
        out = f"replace(translate({out}, '“”‘’–—' || chr(160), '\"\"''''-- '), '…', '...')"
    if ascii_only:
        out = f"regexp_replace({out}, '[^\\x20-\\x7E\\n]', '', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{BLANK}+|{BLANK}+$', '', 'g')"


def key(text: str) -> str:
    return f"md5(trim(regexp_replace(lower({text}), '{BLANK}+', ' ', 'g')))"


def bucket(hash_: str, n: int = 1_000_000) -> str:
    return f"(('0x' || substr({hash_}, 1, 15))::BIGINT % {n})"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9'']+')"


def grams(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n} - 1], ' '))"


ROLES = f"""roles AS (
  SELECT DISTINCT source, lower(regexp_extract(x.v, '[{QUOTES}]\\s*([^{QUOTES}]*?)\\s*[{QUOTES}]', 1)) AS split_name, x.role AS role
  FROM (SELECT source, unnest([{{'role': 'train', 'v': split_protocol.train}}, {{'role': 'validation', 'v': split_protocol.validation}}, {{'role': 'test', 'v': split_protocol.test}}]) AS x FROM data_integrity)
  WHERE source IS NOT NULL AND x.v IS NOT NULL),
corpus AS (
  SELECT t.*, r.role FROM tinystories t JOIN roles r ON t.source = r.source AND lower(regexp_replace(t.hub_split, '^\\s+|\\s+$', '', 'g')) = r.split_name AND r.split_name <> '')"""

PREPARED = f"""{ROLES},
prepared AS (SELECT story_id, source, role, text, {key("text")} AS hash FROM (SELECT story_id, source, role, {norm("text")} AS text FROM corpus WHERE text IS NOT NULL) WHERE length(text) >= 100)"""

SPLITS = f"""{PREPARED},
splits AS (
  SELECT story_id, text, hash, CASE WHEN {bucket("hash")} < 50000 THEN 'validation' ELSE 'train' END AS split FROM prepared WHERE role = 'train'
  UNION ALL SELECT story_id, text, hash, 'test' FROM prepared WHERE role = 'test' AND hash NOT IN (SELECT hash FROM prepared WHERE role = 'train'))"""

KINDS = """kinds AS (
  SELECT *, CASE WHEN val_loss IS NOT NULL THEN 'validation' ELSE 'train' END AS kind FROM training_history),
history AS (
  SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step, kind ORDER BY logged_at DESC NULLS LAST, train_loss DESC NULLS LAST, val_loss DESC NULLS LAST, tokens_seen DESC NULLS LAST, lr DESC NULLS LAST, grad_norm DESC NULLS LAST, tokens_per_second DESC NULLS LAST, train_seconds DESC NULLS LAST) AS place FROM kinds) WHERE place = 1)"""

RUNS = """runs AS (
  SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY validation_loss NULLS LAST, test_loss NULLS LAST, tokens_per_second NULLS LAST) AS place FROM experiments) WHERE place = 1)"""
