"""SQL of boosted quantile trees, written from their definition and not from the operator."""

from __future__ import annotations

from collections.abc import Sequence


def _rank(source: str, value: str, q: float, by: str = "") -> str:
    """(by, v): the value of rank ceil(q * n) of each group."""
    over = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}{value} AS v FROM (SELECT *, row_number() OVER ({over} ORDER BY {value}) AS i, count(*) OVER ({over}) AS n FROM {source}) WHERE i = greatest(ceil({q} * n), 1)"


def boosted_predictions(head: str, source: str, key: str, features: Sequence[str], target: str, edges: Sequence[Sequence[float]], quantiles: Sequence[float], rounds: int, depth: int, rate: float, penalty: float = 1.0) -> str:
    """(key, q0, q1, ...): predictions on the rows of ``source`` that the model was fitted to."""
    ctes, outs = [], []
    bins = ", ".join(f"len(list_filter({list(e)!r}::DOUBLE[], lambda c: c <= {f})) AS b{i}" for i, (f, e) in enumerate(zip(features, edges, strict=True)))
    ctes.append(f"rows0 AS (SELECT {key}, CAST({target} AS DOUBLE) AS y, {bins} FROM {source})")
    each = ", ".join(f"{{'f': {i}, 'b': b{i}, 'last': {len(e)}}}" for i, e in enumerate(edges))
    for k, q in enumerate(quantiles):
        ctes.append(f"s{k}_0 AS (SELECT rows0.*, base.v AS p FROM rows0, ({_rank('rows0', 'y', q)}) base)")
        for r in range(rounds):
            at = f"t{k}_{r}"
            ctes.append(f"{at}_0 AS (SELECT *, CAST(0 AS BIGINT) AS node FROM s{k}_{r})")
            for level in range(depth):
                wide = f"(SELECT node, p >= y AS high, unnest([{each}]) AS x FROM {at}_{level} WHERE node >= {2**level - 1})"
                sums = f"(SELECT node, x.f AS f, e, count(*) AS w, count(*) FILTER (high) AS h, count(*) FILTER (x.b < e) AS lw, count(*) FILTER (high AND x.b < e) AS lh FROM {wide} JOIN range(1, 100) c(e) ON e <= x.last GROUP BY ALL)"
                grads = f"(SELECT *, h * (1 - {q}) - (w - h) * {q} AS g, lh * (1 - {q}) - (lw - lh) * {q} AS lg FROM {sums} WHERE lw >= 1 AND w - lw >= 1)"
                gains = f"(SELECT *, round(0.5 * (lg * lg / (lw + {penalty}) + (g - lg) * (g - lg) / (w - lw + {penalty}) - g * g / (w + {penalty})), 9) AS gain FROM {grads})"
                ctes.append(f"{at}_b{level} AS (SELECT node, f, e FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, e) AS i FROM {gains}) WHERE i = 1 AND gain > 1e-6)")
                value = "CASE b.f " + " ".join(f"WHEN {i} THEN t.b{i}" for i in range(len(features))) + " END"
                ctes.append(f"{at}_{level + 1} AS (SELECT t.* REPLACE (CASE WHEN b.node IS NULL THEN t.node ELSE 2 * t.node + 1 + CASE WHEN {value} < b.e THEN 0 ELSE 1 END END AS node) FROM {at}_{level} t LEFT JOIN {at}_b{level} b ON b.node = t.node)")
            ctes.append(f"{at}_l AS (SELECT *, y - p AS left_over FROM {at}_{depth})")
            ctes.append(f"{at}_v AS ({_rank(f'{at}_l', 'left_over', q, 'node')})")
            ctes.append(f"s{k}_{r + 1} AS (SELECT t.* EXCLUDE (node, p, left_over), p + {rate} * v AS p FROM {at}_l t JOIN {at}_v USING (node))")
        outs.append(f"s{k}_{rounds}")
    picked = ", ".join(f"round({s}.p, 6) AS q{k}" for k, s in enumerate(outs))
    joins = outs[0] + "".join(f" JOIN {s} USING ({key})" for s in outs[1:])
    return f"{head}, {', '.join(ctes)} SELECT {key}, {picked} FROM {joins}"
