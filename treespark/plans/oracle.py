"""Shared parts of the DuckDB check queries: named common table expressions and their assembly."""

from __future__ import annotations

# name -> (names it needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        """SELECT doc_id, ln - 1 AS ln, ls[ln] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM documents)""",
    ),
    "line_sents": (
        ("lines",),
        r"""SELECT doc_id, ln, b, list_slice(w, b, least(b + 23, e)) AS w
  FROM (SELECT doc_id, ln, w, e, unnest(range(CAST(coalesce(es[k - 1], 0) + 1 AS BIGINT), e + 1, 24)) AS b
    FROM (SELECT doc_id, ln, w, es, k, es[k] AS e
      FROM (SELECT doc_id, ln, w, es, unnest(range(1, len(es) + 1)) AS k
        FROM (SELECT doc_id, ln, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR regexp_matches(w[i], '[.!?]$')) AS es
          FROM (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines)))))""",
    ),
    "tb": (
        ("line_sents",),
        r"""SELECT sent_id, doc_id, split, is_gold, n, id, form, head,
  CASE WHEN regexp_matches(form, '[.,]$') THEN 'P' ELSE 'W' || (length(form) % 7) END AS xpos,
  CASE WHEN head = 0 THEN 'root' WHEN head > id THEN 'l' || (head - id)
       ELSE 'r' || (id - head) END AS deprel
FROM (SELECT *, CASE WHEN id = r THEN 0 WHEN id < r THEN least(r, id + 1 + length(form) % 3)
                     ELSE greatest(r, id - 1 - length(form) % 3) END AS head
  FROM (SELECT sent_id, doc_id,
          CASE doc_id % 10 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split,
          CAST(doc_id % 20 IN (3, 10, 11) AS INT) AS is_gold,
          len(w) AS n, len(w) // 2 + 1 AS r, unnest(range(1, len(w) + 1)) AS id, unnest(w) AS form
    FROM (SELECT doc_id, w, doc_id * (SELECT max(length(text)) + 1 FROM documents)
            + row_number() OVER (PARTITION BY doc_id ORDER BY ln, b) - 1 AS sent_id FROM line_sents)))""",
    ),
    "sents": (
        ("tb",),
        """SELECT sent_id, doc_id, split, is_gold, n, list(form ORDER BY id) AS tokens,
  list(head ORDER BY id) AS heads, list(xpos ORDER BY id) AS xposs, list(deprel ORDER BY id) AS deprels
FROM tb GROUP BY sent_id, doc_id, split, is_gold, n""",
    ),
    "closure": (
        ("tb",),
        """SELECT sent_id, id, id AS anc, 0 AS dist FROM tb
UNION ALL
SELECT c.sent_id, c.id, t.head, c.dist + 1 FROM closure c
JOIN tb t ON t.sent_id = c.sent_id AND t.id = c.anc WHERE t.head <> 0""",
    ),
    "dfs": (
        ("tb",),
        """SELECT sent_id, id, [id] AS path FROM tb WHERE head = 0
UNION ALL SELECT t.sent_id, t.id, list_append(d.path, t.id) FROM dfs d JOIN tb t ON t.sent_id = d.sent_id AND t.head = d.id""",
    ),
    "places": (
        ("dfs",),
        "SELECT sent_id, id, row_number() OVER (PARTITION BY sent_id ORDER BY path) - 1 AS place FROM dfs",
    ),
    "ups": (("closure",), "SELECT sent_id, id, list(anc) AS up FROM closure GROUP BY sent_id, id"),
    "sub": (
        ("closure",),
        """SELECT sent_id, anc AS root, count(*) AS size, max(dist) + 1 AS height,
  list(id ORDER BY id) AS members FROM closure GROUP BY sent_id, anc""",
    ),
    "nb": (
        ("closure", "tb"),
        """SELECT DISTINCT c.sent_id, c.anc AS root, t.id
FROM closure c JOIN (SELECT unnest([-1, 1]) AS d) ON true
JOIN tb t ON t.sent_id = c.sent_id AND t.id = c.id + d
WHERE NOT EXISTS (SELECT 1 FROM closure m WHERE m.sent_id = c.sent_id AND m.anc = c.anc AND m.id = t.id)
  AND NOT EXISTS (SELECT 1 FROM closure a WHERE a.sent_id = c.sent_id AND a.id = c.anc AND a.anc = t.id)""",
    ),
    "elig": (
        ("sub", "nb"),
        """SELECT s.sent_id, s.root, s.size, s.height, s.members, v.vals FROM sub s
JOIN (SELECT sent_id, root, list(id ORDER BY id) AS vals FROM nb GROUP BY sent_id, root) v
  ON v.sent_id = s.sent_id AND v.root = s.root
WHERE s.size BETWEEN 2 AND 10""",
    ),
    "wp": (
        ("tb",),
        """SELECT sent_id, split, n, id, form, head, deprel, np, CAST(cum - np + 1 AS BIGINT) AS b, CAST(cum AS BIGINT) AS e
FROM (SELECT *, sum(np) OVER (PARTITION BY sent_id ORDER BY id) AS cum
  FROM (SELECT *, CAST(ceil(length(form) / 4.0) AS BIGINT) AS np FROM tb))""",
    ),
    "pc": (
        ("wp",),
        """SELECT sent_id, split, id, k, b + k - 1 AS pos, b, e,
  CASE WHEN k = 1 THEN substr(form, 1, 4) ELSE '##' || substr(form, (k - 1) * 4 + 1, 4) END AS piece
FROM (SELECT *, unnest(range(1, np + 1)) AS k FROM wp)""",
    ),
    "vocab": (
        ("pc",),
        """SELECT piece, row_number() OVER (ORDER BY piece) + 4 AS piece_id
FROM (SELECT piece FROM pc GROUP BY piece HAVING count(*) >= 2)""",
    ),
    "ids": (
        ("pc", "vocab", "tb"),
        """SELECT p.sent_id, p.split, p.pos, coalesce(v.piece_id, 3) AS token_id FROM pc p LEFT JOIN vocab v ON v.piece = p.piece
UNION ALL SELECT DISTINCT sent_id, split, 0, 1 FROM tb
UNION ALL SELECT sent_id, split, max(pos) + 1, 2 FROM pc GROUP BY sent_id, split""",
    ),
    "pred": (
        ("tb",),
        """SELECT *, CASE WHEN u < 429496729 THEN n // 2 + 1 ELSE head END AS pred_head,
  CASE WHEN u >= 429496729 AND u < 858993458 THEN 'dep' ELSE deprel END AS pred_deprel
FROM (SELECT *, CAST('0x' || substr(md5('42|' || sent_id || '|' || id), 1, 8) AS BIGINT) AS u FROM tb)""",
    ),
    "mlog": (
        (),
        """SELECT event_type AS run, event_id // 500 AS epoch, event_id // 50 AS step,
  event_id % 50 AS val_step, event_id, value FROM events""",
    ),
}


def draw(*keys: str) -> str:
    """The shared integer draw over SQL expressions (text pieces are quoted by the caller)."""
    return f"CAST('0x' || substr({key(*keys)}, 1, 8) AS BIGINT)"


def key(*keys: str) -> str:
    return "md5('42|' || " + " || '|' || ".join(keys) + ")"


def ranks(total: str, count: int, *keys: str) -> str:
    """A list of drawn ranks below ``total``, of up to ``count``."""
    pairs = f"[[j, {draw(*keys, 'j')} % (j + 1)] FOR j IN range(greatest({total} - {count}, 0), {total})]"
    return (f"list_reduce(list_concat([CAST([] AS BIGINT[])], {pairs}), "
            "lambda s, x: list_append(s, CASE WHEN list_contains(s, x[2]) THEN x[1] ELSE x[2] END))")


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` after the named common table expressions and all they need; ``extra`` ones come last."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = CTES[name]
        for need in needs:
            add(need)
        done[name] = text

    for name in names:
        add(name)
    done.update(extra)
    if not done:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in done.items()) + "\n" + body
