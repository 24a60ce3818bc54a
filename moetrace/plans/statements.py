"""Declarative statements of the analyses, over the relations of moetrace.sources.derive (named in braces).

The text depends on the trace's geometry: layers, experts of a layer, and experts of a token (top)."""

from __future__ import annotations


def budget(top: int, times: float = 2.0) -> int:
    """Experts that may be fetched ahead: top times a factor, halves to the even number, one at least."""
    return max(1, round(top * times))


def build(layers: int, experts: int, top: int, window: int = 8, ks: tuple[int, ...] = (1, 2), pairs: bool = True) -> dict[str, str]:
    """The statements by name for a geometry; distances ks that the layers don't reach are left out. Without pairs,
    domain_similarity is added up from sums of profiles: the same result, without a row for each two windows."""
    ALIGNED = "CAST(floor((len + 4095) / 4096) * 4096 AS BIGINT)"
    COUNTS = "SELECT layer, expert, count(*) AS n FROM {trace} GROUP BY layer, expert"
    DENSE = f"SELECT g.layer, g.expert, coalesce(c.n, 0) AS n FROM {{layout}} g LEFT JOIN ({COUNTS}) c ON c.layer = g.layer AND c.expert = g.expert"
    RANKED = f"SELECT layer, n, expert, row_number() OVER (PARTITION BY layer ORDER BY n, expert) AS up, row_number() OVER (PARTITION BY layer ORDER BY n DESC, expert) AS down, sum(n) OVER (PARTITION BY layer) AS total FROM ({DENSE})"
    SKEW = f"""SELECT layer, round(CASE WHEN max(total) = 0 THEN 0.0e0 ELSE 2 * sum(up * n) / ({experts}.0e0 * max(total)) - {experts + 1} / {experts}.0e0 END, 6) AS gini,
      round(-sum(CASE WHEN n > 0 THEN n / CAST(total AS DOUBLE) * ln(n / CAST(total AS DOUBLE)) ELSE 0 END) / ln({max(2, experts)}), 6) AS entropy,
      round(sum(CASE WHEN down <= {max(1, experts // 10)} THEN n ELSE 0 END) / CAST(max(total) AS DOUBLE), 6) AS decile_mass FROM ({RANKED}) GROUP BY layer"""
    #: Distances of the reuse curve.
    FAR = " UNION ALL ".join(["SELECT 1 AS d", *(f"SELECT {d}" for d in range(2, 17))])
    REUSE = f"""SELECT d, layer, round(sum(hit) / count(DISTINCT token) / {top}, 6) AS reuse FROM (
      SELECT d.d, a.layer, a.token, CASE WHEN b.token IS NULL THEN 0.0e0 ELSE 1.0e0 END AS hit
      FROM {{trace}} a CROSS JOIN ({FAR}) d
      CROSS JOIN (SELECT max(token) AS last FROM {{trace}}) m
      LEFT JOIN {{trace}} b ON b.layer = a.layer AND b.expert = a.expert AND b.token = a.token + d.d WHERE a.token + d.d <= m.last) GROUP BY d, layer"""
    JOINT = "SELECT a.layer, a.expert AS a, b.expert AS b, count(*) AS n FROM {trace} a JOIN {trace} b ON a.token = b.token AND a.layer = b.layer AND a.expert < b.expert GROUP BY a.layer, a.expert, b.expert"
    TOKENS = "SELECT layer, count(DISTINCT token) AS tokens FROM {trace} GROUP BY layer"
    EDGES = f"SELECT j.layer, a, b, n, round(n / CAST(tokens AS DOUBLE), 6) AS weight FROM ({JOINT}) j JOIN ({TOKENS}) t ON t.layer = j.layer WHERE n / CAST(tokens AS DOUBLE) >= 0.02e0"
    PAIRS = f"SELECT x.layer, x.expert AS a, y.expert AS b, CAST(x.n AS DOUBLE) * y.n AS mass, coalesce(j.n, 0) AS u FROM ({COUNTS}) x JOIN ({COUNTS}) y ON x.layer = y.layer AND x.expert < y.expert LEFT JOIN ({JOINT}) j ON j.layer = x.layer AND j.a = x.expert AND j.b = y.expert"
    SUMMARY = f"""SELECT layer, round(CASE WHEN sum(u) = 0 THEN 1.0e0 ELSE sum(CASE WHEN mass > 0 AND k > 0 THEN u * (u / (mass * k)) ELSE 0 END) / sum(u) END, 6) AS lift, round(CASE WHEN sum(u) = 0 THEN 0.0e0 ELSE sum(CASE WHEN r <= {experts} THEN u ELSE 0 END) / CAST(sum(u) AS DOUBLE) END, 6) AS concentration FROM (
      SELECT layer, u, mass, sum(u) OVER (PARTITION BY layer) / sum(mass) OVER (PARTITION BY layer) AS k, row_number() OVER (PARTITION BY layer ORDER BY u DESC, a, b) AS r FROM ({PAIRS})) GROUP BY layer"""
    BASKET_EDGES = "SELECT a.expert AS a, b.expert AS b, count(*) AS n FROM {baskets} a JOIN {baskets} b ON a.token = b.token AND a.expert < b.expert GROUP BY a.expert, b.expert"

    def distances(log: str, between: str) -> str:
        """Stack distance of every access that has one before of its key."""
        uses = f"SELECT i, key, lag(i) OVER (PARTITION BY key ORDER BY i) AS prev, lead(i) OVER (PARTITION BY key ORDER BY i) AS next FROM {{{log}}}"
        deep = f"SELECT g.i, sum(CASE WHEN u.next IS NULL OR u.next > g.i THEN 1 ELSE 0 END) AS sd FROM {{{between}}} g JOIN ({uses}) u ON u.i = g.j GROUP BY g.i"
        return f"SELECT u.i, coalesce(d.sd, 0) AS sd FROM ({uses}) u LEFT JOIN ({deep}) d ON d.i = u.i WHERE u.prev IS NOT NULL"

    def lru(log: str, between: str, capacities: tuple[int, ...]) -> str:
        caps = " UNION ALL ".join(f"SELECT {c} AS capacity" for c in capacities)
        # Distances are counted first: the product with the capacities is over few rows.
        counted = f"SELECT sd, count(*) AS n FROM ({distances(log, between)}) GROUP BY sd"
        return f"SELECT c.capacity, CAST(sum(CASE WHEN d.sd < c.capacity THEN d.n ELSE 0 END) AS BIGINT) AS hits FROM ({caps}) c CROSS JOIN ({counted}) d GROUP BY c.capacity"

    LRU_TRACE = lru("accesses", "gaps", tuple(sorted({3, 6, 12, layers * top - 1, layers * top, 19, 32, 48, layers * experts})))
    LRU_LOG = lru("log", "log_gaps", (1, 3, 8, 16, 32, 48, 80, 120, 160))
    KNEE = f"SELECT CAST(min(capacity) AS INT) AS knee FROM ({LRU_TRACE}) h CROSS JOIN (SELECT count(*) AS n FROM {{accesses}}) a WHERE hits / CAST(n AS DOUBLE) >= 0.7e0"
    CLIFF = f"SELECT capacity, round(hits / CAST(n AS DOUBLE), 6) AS hit_rate FROM ({LRU_TRACE}) h CROSS JOIN (SELECT count(*) AS n FROM {{accesses}}) a WHERE capacity IN ({layers * top - 1}, {layers * top})"
    USES = "SELECT i, key, lag(i) OVER (PARTITION BY key ORDER BY i) AS prev_use, lead(i) OVER (PARTITION BY key ORDER BY i) AS next_use FROM {log}"
    OFFSETS = f"SELECT layer, expert, pos, len, CAST(sum({ALIGNED}) OVER (PARTITION BY 1 ORDER BY pos) - {ALIGNED} AS BIGINT) AS off FROM {{layout}}"

    def requests(gap: int | None) -> str:
        """Transfers of each (token, layer), of whole blocks: runs of wanted experts whose gaps are at most gap bytes; None: one each."""
        wants = f"SELECT token, layer, off, {ALIGNED} AS len, lag(off + {ALIGNED}) OVER (PARTITION BY token, layer ORDER BY off) AS upto FROM {{wants}}"
        new = "1" if gap is None else f"CASE WHEN upto IS NULL OR off - upto > {gap} THEN 1 ELSE 0 END"
        runs = f"SELECT token, layer, off, len, sum({new}) OVER (PARTITION BY token, layer ORDER BY off) AS req FROM ({wants})"
        return f"SELECT token, layer, CAST(req AS BIGINT) AS req, min(off) AS file_offset, max(off + len) - min(off) AS span, CAST(sum(len) AS BIGINT) AS wanted, count(*) AS experts FROM ({runs}) GROUP BY token, layer, req"

    def totals(name: str, gap: int | None) -> str:
        return f"SELECT '{name}' AS mode, count(*) AS requests, CAST(sum(span) AS BIGINT) AS transferred, CAST(sum(wanted) AS BIGINT) AS wanted, round(coalesce(sum(span) / CAST(sum(wanted) AS DOUBLE), 1.0e0), 6) AS overfetch FROM ({requests(gap)})"


    INCIDENTAL = f"""SELECT r.token, r.layer, r.req, count(*) AS incidental FROM ({requests(1 << 20)}) r JOIN ({OFFSETS}) o ON o.layer = r.layer AND o.off >= r.file_offset AND o.off < r.file_offset + r.span
      LEFT JOIN {{trace}} t ON t.token = r.token AND t.layer = r.layer AND t.expert = o.expert WHERE t.token IS NULL GROUP BY r.token, r.layer, r.req"""
    BATCHES = "SELECT layer, expert, count(*) AS rows_in, count(DISTINCT token) AS tokens, min(token) AS first_token, max(token) AS last_token, CAST(sum(token * (slot + 1)) AS BIGINT) AS checksum FROM {trace} GROUP BY layer, expert"
    SCHEDULE = f"SELECT layer, CAST(sum(rows_in) AS BIGINT) AS assignments, count(*) AS reads, CAST(sum(rows_in) - count(*) AS BIGINT) AS reads_saved, round(sum(rows_in) / CAST(count(*) AS DOUBLE), 6) AS mean_batch FROM ({BATCHES}) GROUP BY layer"
    WINDOW = window
    PROFILES = f"""SELECT w.domain, w.win, w.layer, w.a, w.b, w.n / sqrt(sum(CAST(w.n AS DOUBLE) * w.n) OVER (PARTITION BY w.domain, w.win)) AS v FROM (
      SELECT a.domain, CAST(floor(a.pos / {WINDOW}) AS BIGINT) AS win, a.layer, a.expert AS a, b.expert AS b, count(*) AS n FROM {{tagged}} a JOIN {{tagged}} b ON a.token = b.token AND a.layer = b.layer AND a.expert < b.expert
      GROUP BY a.domain, CAST(floor(a.pos / {WINDOW}) AS BIGINT), a.layer, a.expert, b.expert) w
      JOIN (SELECT domain, CAST(floor(pos / {WINDOW}) AS BIGINT) AS win FROM {{tagged}} GROUP BY domain, CAST(floor(pos / {WINDOW}) AS BIGINT) HAVING count(DISTINCT pos) = {WINDOW}) f ON f.domain = w.domain AND f.win = w.win"""
    DOMAINS = f"""SELECT round(w, 6) AS within, round(x, 6) AS across, round(w - x, 6) AS separation FROM (
      SELECT sum(CASE WHEN same THEN s ELSE 0 END) / max(n_same) AS w, sum(CASE WHEN same THEN 0 ELSE s END) / max(n_other) AS x FROM (
        SELECT p.domain = q.domain AS same, sum(p.v * q.v) AS s FROM ({PROFILES}) p JOIN ({PROFILES}) q ON p.layer = q.layer AND p.a = q.a AND p.b = q.b AND (p.domain < q.domain OR (p.domain = q.domain AND p.win < q.win)) GROUP BY p.domain, p.win, q.domain, q.win)
      CROSS JOIN (SELECT sum(c * (c - 1) / 2) AS n_same, sum(c) * (sum(c) - 1) / 2 - sum(c * (c - 1) / 2) AS n_other FROM (SELECT domain, count(DISTINCT win) AS c FROM ({PROFILES}) GROUP BY domain)))"""
    # Similarities are scalar products, so those of all pairs of a set add up to (|sum of profiles|^2 - sum of |profile|^2) / 2.
    # No two windows that share a pair of experts: null, as where pairs are joined.
    SUMS = f"""SELECT domain, layer, a, b, sum(v) AS v, sum(v * v) AS vv, count(*) AS k, sum(CASE WHEN own = 1 THEN 1 ELSE 0 END) AS c FROM (
      SELECT domain, layer, a, b, v, row_number() OVER (PARTITION BY domain, win ORDER BY layer, a, b) AS own FROM ({PROFILES})) GROUP BY domain, layer, a, b"""
    SUMMED = f"""SELECT round(w, 6) + 0.0e0 AS within, round(x, 6) + 0.0e0 AS across, round(w - x, 6) + 0.0e0 AS separation FROM (
      SELECT CASE WHEN shared THEN same / nullif(n_same, 0) END AS w, CASE WHEN shared THEN (every - same) / nullif(n * (n - 1) / 2 - n_same, 0) END AS x FROM (
        SELECT max(tk) > 1 AS shared, sum((v * v - vv) / 2) AS same, sum((v * tv - vv) / 2) AS every, sum(c * (dc - 1) / 2) AS n_same, sum(c) AS n FROM (
          SELECT v, vv, c, sum(v) OVER (PARTITION BY layer, a, b) AS tv, sum(k) OVER (PARTITION BY layer, a, b) AS tk, sum(c) OVER (PARTITION BY domain) AS dc FROM ({SUMS}))))"""
    # Separation of domains against circular shifts of the windows. Profiles have length 1, so the similarities within a group
    # of windows add up to (|sum of profiles|^2 - windows) / 2: work grows with windows and shifts, not with pairs of windows.
    # At most 200 shifts, spread evenly, and shift 0, the truth; shifts that leave the grouping as it was are left out.
    STARTS = f"SELECT domain, win, min(start) + win * {WINDOW} AS at FROM (SELECT domain, start, CAST(floor(pos / {WINDOW}) AS BIGINT) AS win FROM {{tagged}}) WHERE (domain, win) IN (SELECT domain, win FROM ({PROFILES})) GROUP BY domain, win"
    SHIFTS = "SELECT DISTINCT token AS shift FROM {tagged} CROSS JOIN (SELECT max(token) + 1 AS n FROM {tagged}) WHERE token = 0 OR floor(token * 200.0e0 / n) > floor((token - 1) * 200.0e0 / n)"
    SHIFTED = f"""SELECT s.shift, w.domain, w.win, b.domain AS label FROM ({STARTS}) w CROSS JOIN ({SHIFTS}) s CROSS JOIN (SELECT max(token) + 1 AS n FROM {{tagged}}) m
      JOIN (SELECT domain, min(token) AS low, max(token) AS high FROM {{tagged}} GROUP BY domain) b ON (w.at + s.shift) % m.n BETWEEN b.low AND b.high"""
    SPLITS = f"SELECT shift, count(DISTINCT domain * 1000000 + label) = count(DISTINCT domain) AND count(DISTINCT domain) = count(DISTINCT label) AS aligned FROM ({SHIFTED}) GROUP BY shift"
    GROUPED = f"SELECT shift, sum((q - c) / 2) AS same, sum(c * (c - 1) / 2.0e0) AS n_same, sum(c) AS n FROM (SELECT x.shift, x.label, max(k.c) AS c, sum(x.v * x.v) AS q FROM (SELECT s.shift, s.label, p.layer, p.a, p.b, sum(p.v) AS v FROM ({SHIFTED}) s JOIN ({PROFILES}) p ON p.domain = s.domain AND p.win = s.win GROUP BY s.shift, s.label, p.layer, p.a, p.b) x JOIN (SELECT shift, label, count(*) AS c FROM ({SHIFTED}) GROUP BY shift, label) k ON k.shift = x.shift AND k.label = x.label GROUP BY x.shift, x.label) GROUP BY shift"
    WHOLE = f"SELECT sum(v * v) AS q FROM (SELECT layer, a, b, sum(v) AS v FROM ({PROFILES}) GROUP BY layer, a, b)"
    SEPARATIONS = f"SELECT g.shift, p.aligned, round(same / n_same - ((q - n) / 2 - same) / (n * (n - 1) / 2.0e0 - n_same), 9) AS separation FROM ({GROUPED}) g JOIN ({SPLITS}) p ON p.shift = g.shift CROSS JOIN ({WHOLE}) w"
    NULLS = f"""SELECT round(max(o.separation), 6) AS observed, round(avg(x.separation), 6) AS null_mean, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY x.separation), 6) AS null_p95,
      CAST(sum(CASE WHEN x.separation >= o.separation THEN 1 ELSE 0 END) AS BIGINT) AS exceeded, count(*) AS shifts,
      round(max(o.separation) - percentile_cont(0.95) WITHIN GROUP (ORDER BY x.separation), 6) AS margin, round((sum(CASE WHEN x.separation >= o.separation THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0e0), 6) AS p_value, max(d.discarded) AS discarded
      FROM ({SEPARATIONS}) x CROSS JOIN (SELECT separation FROM ({SEPARATIONS}) WHERE shift = 0) o CROSS JOIN (SELECT count(*) AS discarded FROM ({SPLITS}) WHERE aligned AND shift > 0) d WHERE x.shift > 0 AND NOT x.aligned"""
    # The experts of the token before, then the smallest others, up to the budget. Only tokens after the split count.
    many = budget(top)
    far_layers = " UNION ALL ".join(f"SELECT {k} AS k" for k in ks if k < layers) or "SELECT 1 AS k WHERE 1 = 0"
    PRIORS = f"""SELECT k, 'persistence' AS prior, round(avg(r), 6) AS recall FROM (
      SELECT k, token, layer, sum(CASE WHEN held OR expert - below < {many - top} THEN 1.0e0 ELSE 0.0e0 END) / {top} AS r FROM (
        SELECT k.k, t.token, t.layer, t.expert, max(CASE WHEN p.expert = t.expert THEN 1 ELSE 0 END) = 1 AS held, sum(CASE WHEN p.expert < t.expert THEN 1 ELSE 0 END) AS below
        FROM {{trace}} t CROSS JOIN ({far_layers}) k CROSS JOIN (SELECT floor(max(token) * 0.7e0) AS cut FROM {{trace}}) c
        JOIN {{trace}} p ON p.token = t.token - 1 AND p.layer = t.layer WHERE t.token - 1 >= cut AND t.layer >= k.k GROUP BY k.k, t.token, t.layer, t.expert) GROUP BY k, token, layer) GROUP BY k
    UNION ALL
    SELECT k, 'static' AS prior, round(avg(r), 6) AS recall FROM (
      SELECT k.k, t.token, t.layer, sum(CASE WHEN s.expert IS NULL THEN 0.0e0 ELSE 1.0e0 END) / {top} AS r FROM {{trace}} t CROSS JOIN ({far_layers}) k CROSS JOIN (SELECT floor(max(token) * 0.7e0) AS cut FROM {{trace}}) c
      LEFT JOIN (SELECT layer, expert FROM (SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, expert) AS r FROM {{trace}} t CROSS JOIN (SELECT floor(max(token) * 0.7e0) AS cut FROM {{trace}}) c WHERE t.token >= 1 AND t.token - 1 < cut GROUP BY layer, expert) WHERE r <= {many}) s
        ON s.layer = t.layer AND s.expert = t.expert WHERE t.token - 1 >= cut AND t.layer >= k.k GROUP BY k.k, t.token, t.layer) GROUP BY k"""
    return {
        "route_topk": "SELECT token, layer, slot, expert FROM {trace}",
        "packed_access_log": "SELECT i, key FROM {accesses}",
        "access_counts_dense": DENSE,
        "skew_by_layer": SKEW,
        "load_cumulative_share": f"SELECT layer, CAST(down AS INT) AS rnk, round(sum(n) OVER (PARTITION BY layer ORDER BY down) / CAST(total AS DOUBLE), 6) AS share FROM ({RANKED})",
        "reuse_curve": REUSE,
        "reuse_by_layer": f"SELECT layer, reuse FROM ({REUSE}) WHERE d = 1",
        "coact_edges": EDGES,
        "coact_joint": f"SELECT j.layer, a, b, round(n / CAST(tokens AS DOUBLE), 6) AS weight FROM ({JOINT}) j JOIN ({TOKENS}) t ON t.layer = j.layer",
        "coact_summary": SUMMARY,
        "coact_baskets": BASKET_EDGES,
        "next_prev_use": USES,
        "lru_hits_by_capacity": LRU_TRACE,
        "lru_hits_log": LRU_LOG,
        "lru_knee": KNEE,
        "lru_cliff": CLIFF,
        "layout_offsets": OFFSETS,
        "plan_per_expert": requests(None),
        "plan_adjacent": requests(0),
        "plan_gap64k": requests(1 << 16),
        "plan_gap1m": requests(1 << 20),
        "plan_incidental": INCIDENTAL,
        "plan_totals": " UNION ALL ".join(totals(n, g) for n, g in (("per_expert", None), ("adjacent", 0), ("gap64k", 1 << 16), ("gap1m", 1 << 20))),
        "invert_batches": BATCHES,
        "schedule_metrics": SCHEDULE,
        "domain_similarity": DOMAINS if pairs else SUMMED,
        "domain_null": NULLS,
        "lookahead_priors": PRIORS,
    }
