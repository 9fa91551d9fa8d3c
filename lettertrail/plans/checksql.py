"""Fragments shared by the checking SQL."""

from ..functions.fingerprint import PERMUTATIONS, PRIME, band_places, coefficients

# Python whitespace as an RE2 class body.
WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def fold(expr: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({expr}, ''), '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def body_norm(expr: str) -> str:
    """Canonical body of text that is already NFKC (true of every shared document)."""
    text = rf"translate({expr}, '‘’′`“”″–—−​‌‍⁠﻿', '''''''''" + '"""' + "---')"
    text = rf"regexp_replace({text}, '(?m)^--[ \t]*$(?s:.*)', '')"
    text = rf"regexp_replace({text}, '(?im)^[ \t>]*(?:sent from my\b|get outlook for\b|sent from mail for windows\b).*$', '', 'g')"
    return fold(f"lower({text})")


def subject_norm(expr: str) -> str:
    lowered = f"lower(replace({strip(f'coalesce({expr}, chr(0))')}, '：', ':'))".replace("chr(0)", "''")
    bare = rf"regexp_replace({lowered}, '^(?:(?:re|fw|fwd|回复|回覆|答复|答覆|转发|轉發):[{WS}]*)+', '')"
    return f"coalesce(nullif({fold(bare)}, ''), 'no-subject')"


def msgid_norm(expr: str) -> str:
    return f"nullif(lower({strip(f'trim({strip(expr)}, chr(60) || chr(62))')}), '')"


def hash28(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 7)) AS BIGINT)"


def shingle_list(norm: str) -> str:
    words = f"string_split({norm}, ' ')"
    return (
        f"CASE WHEN {norm} = '' THEN [] WHEN len({words}) < 5 THEN [{norm}] "
        f"ELSE list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i+4], ' ')) END"
    )


# doc rows -> (id, body_norm, shingle): windows of five words, by row, without repeated list slicing
def shingle_rows(source: str) -> str:
    """`source` has (id, body_norm); yields (id, shingle)."""
    return f"""
SELECT id, concat_ws(' ', w, w2, w3, w4, w5) AS shingle FROM (
  SELECT id, n, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM (SELECT id, unnest(string_split(body_norm, ' ')) AS w, generate_subscripts(string_split(body_norm, ' '), 1) AS p,
               len(string_split(body_norm, ' ')) AS n
        FROM {source} WHERE body_norm <> '') AS words
  WINDOW o AS (PARTITION BY id ORDER BY p)) AS grams
WHERE (n >= 5 AND p <= n - 4) OR (n < 5 AND p = 1)"""


def signature_values() -> str:
    return ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients()))


def signature_columns(h: str = "h") -> str:
    return ", ".join(f"min(({a} * {h} + {b}) % {PRIME}) AS s{i}" for i, (a, b) in enumerate(coefficients()))


SIG_NAMES = [f"s{i}" for i in range(PERMUTATIONS)]


def band_keys() -> list[str]:
    return [f"concat('lsh:{i}:', md5(concat_ws(',', {', '.join(f's{place}' for place in places)})))" for i, places in enumerate(band_places())]
