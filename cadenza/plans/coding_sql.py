"""SQL of coded frames, for any table of band values: what the array expressions of operators/payload.py give, by joins and groups.

The source has `bx` (key, pos, grp, sfb, start, width, wins, i, x: value i of a band), `kq` (key, quality, last, short) and, with presets, `pre` (key, pos,
book, base). The result has for every key its bits as strings of digits: se (sections), sd (scale factors), sp (spectrum), and g0, the gain.
"""

from __future__ import annotations

from cadenza.functions import signal as S
from cadenza.plans import tables as T

CODES = "c(book, idx, len, code) AS (VALUES " + ", ".join(f"({b},{i},{n},{c})" for b, i, n, c in T.code_table()) + ")"


def _digits(size: int, base: int, shift: int, top: int) -> str:
    out = "0"
    for i in range(1, size + 1):
        out = f"({out}) * {base} + " + (f"v[{i}] + {shift}" if shift else f"least(abs(v[{i}]), {top})")
    return out


_PLACES = " ".join(f"WHEN {b} THEN {_digits(n, 2 * t + 1 if s else t + 1, t if s else 0, t)}" for b, (t, n, s) in T.BOOKS.items())


def coded(presets: bool = False, noise_level: int = 4) -> str:
    """CTEs from e to bits; the statement must be recursive."""
    book, base, join = ("pre.book", "coalesce(pre.base, 0)", " LEFT JOIN pre USING (key, pos)") if presets else ("NULL::INT", "0", "")
    return f"""e AS (SELECT key, pos, grp, sfb, start, width, wins, sum(x * x) AS energy, max(x * x) AS peak FROM bx GROUP BY ALL),
t AS (SELECT *, sum(energy) OVER w AS total, sum(width * wins) OVER w AS counted FROM e WINDOW w AS (PARTITION BY key, grp)),
m AS (SELECT t.*, short, sqrt(energy / (width * wins)) AS rms, CASE WHEN total < 0.16 * counted THEN 0 ELSE
 (0.2 * pow(energy / (total / last * width), 0.4) + 0.8 * 0.45 * pow(peak * wins / (total / last * width), 0.4)) * CASE WHEN short THEN 1.5 ELSE 1.0 END * (10.0 / (1 + (2 * start + width) / last)) * quality END AS target FROM t JOIN kq USING (key)),
g AS (SELECT *, CASE WHEN rms < 0.4 OR target = 0 THEN NULL ELSE round_even(log10(target / rms) * {S.STEP!r}, 0) END AS sfac FROM m),
z AS MATERIALIZED (SELECT g.*, coalesce({book}, CASE WHEN sfac IS NULL THEN 0 WHEN target < 0.1 * {noise_level} THEN 13 WHEN sfac > 90 THEN 0 END) AS book,
 CAST({base} + CASE WHEN {book} IS NOT NULL OR sfac IS NULL THEN 0 WHEN target < 0.1 * {noise_level} THEN round_even(log10(greatest(energy / wins, 1e-30)) * {S.STEP / 2!r}, 0) ELSE 100 - sfac END AS INT) AS sf FROM g{join}),
k AS MATERIALIZED (SELECT key, pos, i, CAST(sign(x) * floor(pow(abs(x) * pow(10, sfac / {S.STEP!r}), 0.75) + {S.ROUNDING}) AS INT) AS q FROM bx JOIN z USING (key, pos) WHERE book IS NULL),
o AS (SELECT key, pos, max(abs(q)) AS top FROM k GROUP BY ALL),
cand AS (SELECT key, pos, unnest(CASE WHEN top < 1 THEN [0] WHEN top < 2 THEN [1, 2] WHEN top < 3 THEN [3, 4] WHEN top < 5 THEN [5, 6] WHEN top < 8 THEN [7, 8] WHEN top < 13 THEN [9, 10] ELSE [11] END) AS book FROM o),
t4 AS (SELECT key, pos, i // 4 AS t, list(q ORDER BY i) AS v, 4 AS size FROM k GROUP BY ALL UNION ALL SELECT key, pos, i // 2, list(q ORDER BY i), 2 FROM k GROUP BY ALL),
i AS (SELECT *, CASE book {_PLACES} END AS idx FROM t4 JOIN cand USING (key, pos) WHERE (book BETWEEN 1 AND 4 AND size = 4) OR (book >= 5 AND size = 2)),
{CODES}, sized AS (SELECT key, pos, book, sum(len + CASE WHEN book IN (3, 4, 7, 8, 9, 10, 11) THEN len(list_filter(v, lambda a: a <> 0)) ELSE 0 END
 + CASE WHEN book = 11 THEN coalesce(list_sum(list_transform(list_filter(v, lambda a: abs(a) >= 16), lambda a: 2 * (floor(log2(abs(a) + 0.5)) - 4) + 5)), 0) ELSE 0 END)::BIGINT AS bits FROM i JOIN c USING (book, idx) GROUP BY ALL
 UNION ALL SELECT key, pos, 0, 0 FROM cand WHERE book = 0),
best AS MATERIALIZED (SELECT key, pos, arg_min(book, (bits, book)) AS book FROM sized GROUP BY ALL),
allb AS MATERIALIZED (SELECT z.key, z.pos, grp, short, sf, coalesce(z.book, best.book) AS book FROM z LEFT JOIN best ON z.book IS NULL AND best.key = z.key AND best.pos = z.pos),
gg AS (SELECT key, coalesce(arg_min(sf, pos) FILTER (book NOT IN (0, 14, 15)), 0) AS g0 FROM allb GROUP BY ALL),
fold AS (SELECT key, -1 AS pos, g0 AS g, 0 AS ist, g0 - 90 AS nz, false AS heard, NULL::INT AS kind, NULL::INT AS diff FROM gg
 UNION ALL SELECT key, pos, CASE WHEN book NOT IN (0, 13, 14, 15) THEN g + d ELSE g END, CASE WHEN book IN (14, 15) THEN ist + d ELSE ist END, CASE WHEN book = 13 THEN nz + d ELSE nz END, heard OR book = 13,
  CASE WHEN book = 0 THEN NULL WHEN book IN (14, 15) THEN 1 WHEN book = 13 AND NOT heard THEN 3 WHEN book = 13 THEN 2 ELSE 0 END, CASE WHEN book <> 0 THEN d END
 FROM (SELECT key, s.pos, s.book, g, ist, nz, heard, CASE WHEN s.book = 13 AND NOT heard THEN sf - nz ELSE greatest(least(sf - CASE WHEN s.book = 13 THEN nz WHEN s.book IN (14, 15) THEN ist ELSE g END, 60), -60) END AS d FROM fold JOIN allb s USING (key) WHERE s.pos = fold.pos + 1)),
u AS (SELECT *, row_number() OVER (PARTITION BY key, grp ORDER BY pos) - row_number() OVER (PARTITION BY key, grp, book ORDER BY pos) AS island FROM allb),
runs AS (SELECT key, grp, book, island, short, min(pos) AS start, count(*) AS run FROM u GROUP BY ALL),
w1 AS (SELECT key, string_agg(lpad(bin(code), len, '0') || CASE WHEN i.book IN (3, 4, 7, 8, 9, 10, 11) THEN array_to_string(list_transform(list_filter(v, lambda a: a <> 0), lambda a: CASE WHEN a < 0 THEN '1' ELSE '0' END), '') ELSE '' END
 || CASE WHEN i.book = 11 THEN array_to_string(list_transform(list_filter(v, lambda a: abs(a) >= 16), lambda a: repeat('1', len(bin(abs(a))) - 5) || '0' || substr(bin(abs(a)), 2)), '') ELSE '' END, '' ORDER BY i.pos, t) AS sp
 FROM i JOIN best USING (key, pos, book) JOIN c USING (book, idx) GROUP BY key),
w2 AS (SELECT key, string_agg(lpad(bin(book), 4, '0') || CASE WHEN short THEN repeat('111', (run // 7)::INT) || lpad(bin(run % 7), 3, '0') ELSE repeat('11111', (run // 31)::INT) || lpad(bin(run % 31), 5, '0') END, '' ORDER BY start) AS se FROM runs GROUP BY key),
w3 AS (SELECT key, string_agg(CASE WHEN kind = 3 THEN lpad(bin((diff + 256) & 511), 9, '0') ELSE lpad(bin(code), len, '0') END, '' ORDER BY pos) AS sd FROM fold LEFT JOIN c ON book = 12 AND idx = diff + 60 WHERE kind IS NOT NULL GROUP BY key),
bits AS (SELECT key, g0, se, coalesce(sd, '') AS sd, coalesce(sp, '') AS sp FROM gg JOIN w2 USING (key) LEFT JOIN w3 USING (key) LEFT JOIN w1 USING (key))"""


#: Hexadecimal digits of a string d of whole bytes.
HEX = "array_to_string([substr('0123456789ABCDEF', 1 + 8 * substr(d, 4 * i + 1, 1)::INT + 4 * substr(d, 4 * i + 2, 1)::INT + 2 * substr(d, 4 * i + 3, 1)::INT + substr(d, 4 * i + 4, 1)::INT, 1) FOR i IN range(len(d) // 4)], '')"


def closed(frame: str) -> str:
    """CTEs shut (key, n_bits, d) of a table of (key, d): the end mark and zeros up to whole bytes. Frames are longer than a byte."""
    return f"shut AS (SELECT key, CAST(len(d) + 3 AS INT) AS n_bits, d || '111' || repeat('0', ((8 - (len(d) + 3) % 8) % 8)::INT) AS d FROM {frame})"
