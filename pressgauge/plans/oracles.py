"""Plain SQL for the registered queries, written independently of the library, for comparison.

Each text is a chain of common table expressions and one final SELECT.
"""

from __future__ import annotations

from collections.abc import Sequence

Chain = list[tuple[str, str]]


def build(chain: Chain, final: str) -> str:
    steps = ",\n".join(f"{name} AS ({body})" for name, body in chain)
    return f"WITH {steps}\n{final}"


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


# --- line items -------------------------------------------------------------------------------

TOPICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "other_econ"]


def values(names: Sequence[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


ARTICLES: Chain = [
    (
        "art",
        """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unique_article_id,
        CAST(l_orderkey AS VARCHAR) AS story_key, l_shipdate AS d,
        CAST(date_trunc('week', l_shipdate) AS DATE) AS "week", n_name AS region, l_returnflag,
        l_quantity >= 5 AS is_candidate,
        CASE l_returnflag WHEN 'R' THEN 'strong_keyword' WHEN 'A' THEN 'weak_keyword' ELSE 'url_section' END
          AS candidate_source
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    ),
    ("cand", "SELECT * FROM art WHERE is_candidate"),
    (
        "groups",
        """SELECT story_key, region, "week", count(*) AS group_rows,
        count(*) FILTER (WHERE is_candidate) AS c FROM art GROUP BY story_key, region, "week" """,
    ),
    ("spread", "SELECT story_key, CAST(count(DISTINCT region) AS INTEGER) AS region_spread FROM cand GROUP BY story_key"),
    (
        "scores",
        """SELECT CAST(o_orderkey AS VARCHAR) AS story_key, o_orderstatus <> 'P' AS is_econ,
        CASE WHEN o_orderstatus = 'P' THEN 'unassigned'
             WHEN o_orderpriority = '5-LOW' THEN 'other_econ' ELSE o_orderpriority END AS assigned_topic,
        0.45::DOUBLE + floor(o_totalprice / 100.0::DOUBLE) * 0.0000513717::DOUBLE AS top1_similarity FROM orders""",
    ),
    (
        "weighed",
        """SELECT story_key, region, "week", region_spread, is_econ, assigned_topic, top1_similarity,
        (c::DOUBLE / group_rows) / sqrt(region_spread) AS effective_weight
        FROM groups JOIN spread USING (story_key) JOIN scores USING (story_key) WHERE c > 0""",
    ),
]


def panel_chain(topics: Sequence[str]) -> Chain:
    """From `weighed` to the index."""
    return [
        (
            "totals",
            """SELECT "week", region, sum(effective_weight) AS total_econ_weight FROM weighed
            WHERE is_econ GROUP BY "week", region""",
        ),
        (
            "cells",
            """SELECT "week", region, assigned_topic AS topic, sum(effective_weight) AS n_articles,
            CASE WHEN sum(effective_weight) > 0
              THEN sum(top1_similarity * effective_weight) / sum(effective_weight) ELSE 0 END AS mean_similarity
            FROM weighed WHERE is_econ AND assigned_topic <> 'unassigned' GROUP BY "week", region, assigned_topic""",
        ),
        ("topics", f"SELECT * FROM (VALUES {values(topics)}) t(topic)"),
        (
            "panel",
            """SELECT t."week", t.region, k.topic, total_econ_weight,
            coalesce(n_articles, 0) AS n_articles, coalesce(mean_similarity, 0) AS mean_similarity,
            CASE WHEN total_econ_weight > 0 THEN coalesce(n_articles, 0) / total_econ_weight ELSE 0 END AS topic_share
            FROM totals t CROSS JOIN topics k
            LEFT JOIN cells c ON c."week" = t."week" AND c.region = t.region AND c.topic = k.topic""",
        ),
        (
            "priors",
            """SELECT topic, sum(n_articles) / (SELECT sum(total_econ_weight) FROM panel) AS topic_prior
            FROM panel GROUP BY topic""",
        ),
        (
            "post",
            """SELECT panel.*, topic_prior,
            (n_articles + topic_prior * 20.0::DOUBLE) / (total_econ_weight + 20.0::DOUBLE) AS p_post
            FROM panel JOIN priors USING (topic)""",
        ),
        (
            "base",
            """SELECT *, coalesce(CASE WHEN count(p_post) OVER w8 >= 3 THEN avg(p_post) OVER w8 END, topic_prior)
              AS baseline_share,
            CASE WHEN count(p_post) OVER w4 >= 2 THEN avg(p_post) OVER w4 END AS recent_raw
            FROM post WINDOW
            w8 AS (PARTITION BY region, topic ORDER BY "week" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
            w4 AS (PARTITION BY region, topic ORDER BY "week" ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
        ),
        (
            "surp",
            """SELECT *, coalesce(recent_raw, baseline_share) AS recent_share,
            p_post - baseline_share AS surprise,
            p_post - coalesce(recent_raw, baseline_share) AS momentum FROM base""",
        ),
        (
            "islands",
            """SELECT *, sum(CASE WHEN round(surprise, 12) > 0 THEN 0 ELSE 1 END) OVER
              (PARTITION BY region, topic ORDER BY "week" ROWS UNBOUNDED PRECEDING) AS island FROM surp""",
        ),
        (
            "runs",
            """SELECT *, CAST(sum(CASE WHEN round(surprise, 12) > 0 THEN 1 ELSE 0 END) OVER
              (PARTITION BY region, topic, island ORDER BY "week" ROWS UNBOUNDED PRECEDING) AS INTEGER)
              AS persistence_weeks FROM islands""",
        ),
        (
            "stats",
            """SELECT topic, avg(surprise) AS sm, stddev_pop(surprise) AS ss, avg(momentum) AS mm,
            stddev_pop(momentum) AS ms, avg(mean_similarity) AS cm, stddev_pop(mean_similarity) AS cs
            FROM surp GROUP BY topic""",
        ),
        (
            "zed",
            """SELECT runs.*,
            CASE WHEN ss > 0 THEN greatest(-3.0, least(3.0, (surprise - sm) / ss)) ELSE 0 END AS surprise_z,
            CASE WHEN ms > 0 THEN greatest(-3.0, least(3.0, (momentum - mm) / ms)) ELSE 0 END AS momentum_z,
            CASE WHEN cs > 0 THEN greatest(-3.0, least(3.0, (mean_similarity - cm) / cs)) ELSE 0 END
              AS mean_similarity_z
            FROM runs JOIN stats USING (topic)""",
        ),
        (
            "idx",
            """SELECT "week", region, topic, n_articles, total_econ_weight, topic_share, mean_similarity,
            baseline_share, surprise, momentum, persistence_weeks,
            sqrt(total_econ_weight / (total_econ_weight + 5.0::DOUBLE)) * (0.5::DOUBLE * surprise_z
              + 0.3::DOUBLE * momentum_z + 0.2::DOUBLE * mean_similarity_z) AS risk_score FROM zed""",
        ),
        ("b", "SELECT * FROM idx WHERE topic <> 'other_econ'"),
    ]


def output_chain(first_year: int, second_year: int) -> Chain:
    return [
        (
            "refw",
            f"""SELECT coalesce(max(CASE WHEN year("week") = {first_year} THEN "week" END),
            max(CASE WHEN year("week") = {second_year} THEN "week" END), max("week")) AS reference_week
            FROM b WHERE n_articles > 0""",
        ),
        (
            "past",
            """SELECT DISTINCT "week" FROM b WHERE n_articles > 0
            AND "week" <= (SELECT reference_week FROM refw)""",
        ),
        ("last4", 'SELECT "week" FROM past ORDER BY "week" DESC LIMIT 4'),
        ("last12", 'SELECT "week" FROM past ORDER BY "week" DESC LIMIT 12'),
        ("refp", 'SELECT * FROM b WHERE n_articles > 0 AND "week" = (SELECT reference_week FROM refw)'),
        ("latest", "SELECT * FROM refp ORDER BY risk_score DESC, region, topic LIMIT 25"),
        (
            "rolling",
            """SELECT max("week") AS "week", region, topic, sum(n_articles) AS n_articles,
            avg(total_econ_weight) AS total_econ_weight, avg(topic_share) AS topic_share,
            avg(mean_similarity) AS mean_similarity, avg(baseline_share) AS baseline_share,
            avg(surprise) AS surprise, avg(momentum) AS momentum, max(persistence_weeks) AS persistence_weeks,
            avg(risk_score) AS risk_score
            FROM b WHERE n_articles > 0 AND "week" IN (SELECT "week" FROM last4) GROUP BY region, topic
            ORDER BY risk_score DESC, region, topic LIMIT 25""",
        ),
        (
            "ranking",
            """SELECT topic, sum(greatest(risk_score, 0)) AS total_risk, count(DISTINCT region) AS active_regions,
            max(risk_score) AS max_risk FROM refp GROUP BY topic""",
        ),
        (
            "showcase",
            "SELECT * FROM ranking ORDER BY total_risk DESC, active_regions DESC, max_risk DESC, topic LIMIT 1",
        ),
        (
            "swin",
            """SELECT * FROM b WHERE topic = (SELECT topic FROM showcase)
            AND "week" IN (SELECT "week" FROM last12)""",
        ),
        (
            "treg",
            """SELECT region, count(*) FILTER (WHERE n_articles > 0) AS active_weeks,
            sum(greatest(risk_score, 0)) AS positive_risk, avg(topic_share) AS avg_topic_share,
            coalesce(max(CASE WHEN "week" = (SELECT reference_week FROM refw) THEN risk_score END), 0)
              AS reference_week_risk
            FROM swin GROUP BY region ORDER BY active_weeks DESC, positive_risk DESC,
            reference_week_risk DESC, avg_topic_share DESC, region LIMIT 5""",
        ),
        (
            "overall",
            """SELECT "week", region, sum(greatest(risk_score, 0)) AS overall_risk,
            count(*) FILTER (WHERE n_articles > 0) AS active_topics, avg(topic_share) AS mean_topic_share
            FROM b WHERE "week" IN (SELECT "week" FROM last12) GROUP BY "week", region""",
        ),
        (
            "topreg",
            """SELECT region, sum(overall_risk) AS total_risk,
            count(*) FILTER (WHERE overall_risk > 0) AS active_weeks, arg_max(overall_risk, "week") AS last_risk
            FROM overall GROUP BY region
            ORDER BY total_risk DESC, active_weeks DESC, last_risk DESC, region LIMIT 5""",
        ),
        (
            "bench",
            """SELECT "week", avg(overall_risk) AS overall_risk, avg(active_topics) AS active_topics
            FROM overall GROUP BY "week" """,
        ),
        (
            "rmap",
            """SELECT region, risk_score, n_articles FROM b
            WHERE "week" = (SELECT reference_week FROM refw) AND topic = (SELECT topic FROM showcase)""",
        ),
        (
            "mmap",
            f"""SELECT region, avg(risk_score) AS risk_score, sum(n_articles) AS n_articles FROM b
            WHERE topic = (SELECT topic FROM showcase) AND year("week") = {second_year} AND month("week") = 12
            GROUP BY region""",
        ),
        (
            "leaders",
            """SELECT region, topic AS top_topic, risk_score AS top_risk_score FROM (SELECT *, row_number() OVER
              (PARTITION BY region ORDER BY risk_score DESC, topic) AS rn FROM refp) WHERE rn = 1""",
        ),
    ]


LINE = ARTICLES + panel_chain(TOPICS) + output_chain(2000, 1999)


def line(final: str) -> str:
    return build(LINE, final)


PAIR_ROUNDED = r6(
    "n_articles", "total_econ_weight", "topic_share", "mean_similarity", "baseline_share", "surprise", "momentum",
    "risk_score",
)
PAIR = f'"week", region, topic, persistence_weeks, {PAIR_ROUNDED}'
CELL = '"week", region, topic'

STORY: Chain = ARTICLES + [
    ("buckets", 'SELECT story_key, region, "week", count(*) AS article_rows FROM cand GROUP BY ALL'),
    (
        "prim",
        """SELECT story_key, region, "week", article_rows FROM (SELECT *, row_number() OVER (PARTITION BY story_key
        ORDER BY article_rows DESC,
          sha256(concat_ws('::', '42', story_key, region, strftime("week", '%Y-%m-%d'))), region, "week") AS rn
        FROM buckets) WHERE rn = 1""",
    ),
    (
        "first",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_key ORDER BY d, unique_article_id) AS rn
        FROM cand) WHERE rn = 1""",
    ),
    (
        "flags",
        """SELECT c.story_key, f.candidate_source, bool_or(c.l_returnflag = 'R') AS strong_keyword_hit,
        f.l_returnflag = 'R' AS first_strong FROM cand c JOIN first f USING (story_key)
        GROUP BY c.story_key, f.candidate_source, f.l_returnflag""",
    ),
    (
        "meta",
        """SELECT p.story_key, p.region, p."week", s.region_spread, n.article_rows, f.candidate_source,
        f.strong_keyword_hit, CASE WHEN f.first_strong THEN 'strong' ELSE 'weak_url' END AS sampling_tier
        FROM prim p JOIN spread s USING (story_key) JOIN flags f USING (story_key)
        JOIN (SELECT story_key, count(*) AS article_rows FROM cand GROUP BY story_key) n USING (story_key)""",
    ),
]


def sample_chain(cap: int, strong_goal: int) -> Chain:
    """From `meta` to `sample`."""
    return [
        (
            "avail",
            """SELECT count(*) FILTER (WHERE sampling_tier = 'strong') AS s,
            count(*) FILTER (WHERE sampling_tier = 'weak_url') AS w FROM meta""",
        ),
        (
            "base_t",
            f"SELECT s, w, least({strong_goal}, s) AS s0, least({cap} - {strong_goal}, w) AS w0 FROM avail",
        ),
        ("add_s", f"SELECT *, least({cap} - s0 - w0, s - s0) AS s1 FROM base_t"),
        ("add_w", f"SELECT *, least({cap} - s0 - w0 - s1, w - w0) AS w1 FROM add_s"),
        (
            "targets",
            """SELECT 'strong' AS sampling_tier, s AS available, s0 + s1 AS target FROM add_w
            UNION ALL SELECT 'weak_url', w, w0 + w1 FROM add_w""",
        ),
        (
            "shares",
            """SELECT sampling_tier, region, "week", story_count, available, target,
            story_count::DOUBLE / available * target AS raw FROM (SELECT sampling_tier, region, "week",
              count(*) AS story_count FROM meta GROUP BY sampling_tier, region, "week")
            JOIN targets USING (sampling_tier)""",
        ),
        (
            "floors",
            """SELECT *, CASE WHEN available <= target THEN story_count ELSE CAST(floor(raw) AS BIGINT) END AS base,
            raw - floor(raw) AS remainder FROM shares""",
        ),
        (
            "quotas",
            """SELECT sampling_tier, region, "week", story_count, base + CASE WHEN available > target
              AND row_number() OVER (PARTITION BY sampling_tier ORDER BY remainder DESC, region, "week")
                <= target - sum(base) OVER (PARTITION BY sampling_tier) THEN 1 ELSE 0 END AS quota FROM floors""",
        ),
        (
            "sample",
            """SELECT * FROM (SELECT m.*, quota, row_number() OVER (PARTITION BY m.sampling_tier, m.region, m."week"
              ORDER BY sha256(concat_ws('::', '42', m.sampling_tier, story_key)), story_key) AS rn
            FROM meta m JOIN quotas q ON m.sampling_tier = q.sampling_tier AND m.region = q.region
              AND m."week" = q."week") WHERE rn <= quota""",
        ),
    ]


LINE_SAMPLE = STORY + sample_chain(6000, 4200)

ARTICLE_LEVEL: Chain = ARTICLES + [
    (
        "sa",
        """SELECT c.unique_article_id, c.story_key, c."week", c.region, c.candidate_source, 1.0::DOUBLE / g.group_rows AS dup_weight,
        region_spread, (1.0::DOUBLE / g.group_rows) / sqrt(region_spread) AS effective_weight, is_econ, assigned_topic,
        top1_similarity, CASE assigned_topic WHEN 'unassigned' THEN 'rejected_candidate'
          WHEN 'other_econ' THEN 'other_econ' ELSE 'boe_topic' END AS review_group
        FROM cand c JOIN groups g ON g.story_key = c.story_key AND g.region = c.region AND g."week" = c."week"
        JOIN spread s ON s.story_key = c.story_key JOIN scores o ON o.story_key = c.story_key""",
    )
]

ORACLES: dict[str, str] = {
    "dup_weight": build(
        ARTICLES,
        f"""SELECT unique_article_id, a.story_key, a.region, a."week", {r6("dup_weight")} FROM (SELECT a.*,
        1.0::DOUBLE / group_rows AS dup_weight FROM art a JOIN groups g ON a.story_key = g.story_key
        AND a.region = g.region AND a."week" = g."week") a""",
    ),
    "group_sizes": build(ARTICLES, 'SELECT story_key, region, "week", group_rows FROM groups'),
    "bucket_weights": build(
        ARTICLES,
        f"""SELECT story_key, region, "week", {r6("dup_weight")} FROM
        (SELECT *, c::DOUBLE / group_rows AS dup_weight FROM groups WHERE c > 0)""",
    ),
    "region_spread": build(ARTICLES, "SELECT * FROM spread"),
    "score_articles": build(
        ARTICLE_LEVEL,
        f"""SELECT unique_article_id, story_key, "week", region, region_spread, is_econ, assigned_topic, review_group,
        {r6("dup_weight", "effective_weight", "top1_similarity")} FROM sa""",
    ),
    "effective_weight": build(
        ARTICLES, f'SELECT story_key, region, "week", region_spread, {r6("effective_weight")} FROM weighed'
    ),
    "econ_totals": line(f'SELECT "week", region, {r6("total_econ_weight")} FROM totals'),
    "topic_cells": line(f'SELECT {CELL}, {r6("n_articles", "mean_similarity")} FROM cells'),
    "dense_panel": line(
        f'SELECT {CELL}, {r6("total_econ_weight", "n_articles", "mean_similarity", "topic_share")} FROM panel'
    ),
    "topic_prior": line(f'SELECT topic, {r6("topic_prior")} FROM priors'),
    "topic_prior_per_region_week": line(
        f"""SELECT topic, {r6("topic_prior")} FROM (SELECT topic, sum(n_articles) / sum(total_econ_weight)
        AS topic_prior FROM panel GROUP BY topic)"""
    ),
    "posterior_share": line(f'SELECT {CELL}, {r6("topic_prior", "p_post")} FROM post'),
    "baseline_share": line(f'SELECT {CELL}, {r6("baseline_share")} FROM surp'),
    "recent_share": line(f'SELECT {CELL}, {r6("recent_share")} FROM surp'),
    "surprise_momentum": line(f'SELECT {CELL}, {r6("surprise", "momentum")} FROM surp'),
    "persistence_weeks": line(f"SELECT {CELL}, persistence_weeks FROM runs"),
    "topic_zscores": line(f'SELECT {CELL}, {r6("surprise_z", "momentum_z", "mean_similarity_z")} FROM zed'),
    "support": line(
        f"""SELECT "week", region, {r6("total_econ_weight", "support")} FROM (SELECT *,
        sqrt(total_econ_weight / (total_econ_weight + 5.0::DOUBLE)) AS support FROM totals)"""
    ),
    "risk_index": line(f"SELECT {PAIR} FROM idx"),
    "top_risk_rows": line(
        f"""SELECT {PAIR} FROM (SELECT * FROM idx ORDER BY risk_score DESC, region, topic, "week" LIMIT 20)"""
    ),
    "reference_week": line("SELECT * FROM refw"),
    "recent_active_weeks": line("SELECT * FROM last4"),
    "trend_active_weeks": line("SELECT * FROM last12"),
    "latest_pairs": line(f"SELECT {PAIR}, 'reference_week' AS \"window\" FROM latest"),
    "rolling_pairs": line(f"SELECT {PAIR}, 'recent_active_weeks' AS \"window\" FROM rolling"),
    "hot_pairs": line(
        f"""SELECT {PAIR}, 'reference_week' AS "window" FROM latest UNION ALL
        SELECT {PAIR}, 'recent_active_weeks' AS "window" FROM rolling"""
    ),
    "topic_ranking": line(f'SELECT topic, active_regions, {r6("total_risk", "max_risk")} FROM ranking'),
    "showcase_topic": line(f'SELECT topic, active_regions, {r6("total_risk", "max_risk")} FROM showcase'),
    "trend_regions": line(
        f'SELECT region, active_weeks, {r6("positive_risk", "avg_topic_share", "reference_week_risk")} FROM treg'
    ),
    "topic_trend": line(
        f"""SELECT "week", series, {r6("topic_share", "risk_score")} FROM (SELECT "week", region AS series, topic_share,
        risk_score FROM swin WHERE region IN (SELECT region FROM treg) UNION ALL
        SELECT "week", 'mean', avg(topic_share), avg(risk_score) FROM swin GROUP BY "week")"""
    ),
    "overall_region_risk": line(
        f'SELECT "week", region, active_topics, {r6("overall_risk", "mean_topic_share")} FROM overall'
    ),
    "top_regions_overall": line(f'SELECT region, active_weeks, {r6("total_risk", "last_risk")} FROM topreg'),
    "weekly_benchmark": line(f'SELECT "week", {r6("overall_risk", "active_topics")} FROM bench'),
    "overall_region_trend": line(
        f"""SELECT "week", series, {r6("overall_risk", "active_topics")} FROM (SELECT "week", region AS series,
        overall_risk, active_topics::DOUBLE AS active_topics FROM overall
        WHERE region IN (SELECT region FROM topreg) UNION ALL
        SELECT "week", 'mean', overall_risk, active_topics FROM bench)"""
    ),
    "reference_map": line(f'SELECT region, {r6("risk_score", "n_articles")} FROM rmap'),
    "month_average": line(f'SELECT region, {r6("risk_score", "n_articles")} FROM mmap'),
    "region_leaders": line(f'SELECT region, top_topic, {r6("top_risk_score")} FROM leaders'),
    "leader_legend": line(
        f"""SELECT top_topic, regions, {r6("max_risk")} FROM (SELECT top_topic, count(DISTINCT region) AS regions,
        max(top_risk_score) AS max_risk FROM leaders WHERE top_risk_score > 0 GROUP BY top_topic)"""
    ),
    "leader_labels": line(
        """SELECT region, CASE WHEN top_risk_score > 0 THEN top_topic ELSE 'No positive topic signal' END AS label
        FROM leaders"""
    ),
    "reference_map_legend": line(
        f"""SELECT region, "rank", {r6("risk_score", "n_articles")} FROM (SELECT *, CAST(row_number() OVER
        (ORDER BY risk_score DESC, region) AS INTEGER) AS "rank" FROM rmap WHERE risk_score > 0 OR
        NOT EXISTS (SELECT 1 FROM rmap WHERE risk_score > 0)) WHERE "rank" <= 8"""
    ),
    "month_map_legend": line(
        f"""SELECT region, "rank", {r6("risk_score", "n_articles")} FROM (SELECT *, CAST(row_number() OVER
        (ORDER BY risk_score DESC, n_articles DESC, region) AS INTEGER) AS "rank" FROM mmap WHERE risk_score > 0 OR
        NOT EXISTS (SELECT 1 FROM mmap WHERE risk_score > 0)) WHERE "rank" <= 8"""
    ),
    "scoring_profile": line(
        f"""SELECT scored_articles, economic_articles, boe_topic_articles, other_econ_articles, regions_in_index,
        weeks_in_index, {r6("other_econ_share_among_econ_articles")} FROM (SELECT count(*) AS scored_articles,
        count(*) FILTER (WHERE is_econ) AS economic_articles,
        count(*) FILTER (WHERE assigned_topic IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))
          AS boe_topic_articles,
        count(*) FILTER (WHERE assigned_topic = 'other_econ') AS other_econ_articles,
        (SELECT count(DISTINCT region) FROM idx) AS regions_in_index,
        (SELECT count(DISTINCT "week") FROM idx) AS weeks_in_index,
        avg(CASE WHEN is_econ THEN CASE WHEN assigned_topic = 'other_econ' THEN 1 ELSE 0 END END)
          AS other_econ_share_among_econ_articles FROM weighed)"""
    ),
    "topic_value_counts": line('SELECT assigned_topic, count(*) AS "rows" FROM weighed WHERE is_econ GROUP BY 1'),
    "story_score_summary": build(
        ARTICLES,
        """SELECT count(*) AS embedded_story_keys, count(*) FILTER (WHERE is_econ) AS economic_story_keys,
        count(*) FILTER (WHERE assigned_topic = 'other_econ') AS other_econ_story_keys,
        count(*) FILTER (WHERE assigned_topic = 'unassigned') AS unassigned_story_keys FROM scores""",
    ),
    "story_buckets": build(STORY, "SELECT * FROM buckets"),
    "primary_bucket": build(STORY, "SELECT * FROM prim"),
    "story_first_row": build(STORY, "SELECT story_key, unique_article_id, candidate_source FROM first"),
    "story_flags": build(STORY, "SELECT story_key, candidate_source, strong_keyword_hit FROM flags"),
    "story_meta": build(STORY, "SELECT * FROM meta"),
    "tier_targets": build(LINE_SAMPLE, "SELECT * FROM targets"),
    "quota_allocation": build(
        LINE_SAMPLE,
        'SELECT sampling_tier, region, "week", story_count, CAST(quota AS BIGINT) AS quota FROM quotas',
    ),
    "story_sample": build(LINE_SAMPLE, 'SELECT story_key, sampling_tier, region, "week" FROM sample'),
    "story_numbers": build(
        STORY,
        "SELECT story_key, row_number() OVER (ORDER BY story_key) - 1 AS embedding_row FROM prim",
    ),
    "review_sample": build(
        ARTICLE_LEVEL,
        """SELECT review_group, unique_article_id, "week", region, candidate_source, assigned_topic FROM (SELECT *,
        row_number() OVER (PARTITION BY review_group ORDER BY sha256('42::' || unique_article_id),
        unique_article_id) AS rn FROM sa) WHERE rn <= 20""",
    ),
    "rebuilt_lookup": build(
        ARTICLES,
        """SELECT CAST(o_orderkey AS VARCHAR) AS story_key, CAST(o_orderkey AS BIGINT) AS embedding_row,
        o_orderpriority AS text_for_embedding, o_orderstatus AS region,
        CAST(date_trunc('week', o_orderdate) AS DATE) AS "week", 'dev' AS run_mode,
        coalesce(region_spread, 1) AS region_spread
        FROM orders LEFT JOIN spread ON story_key = CAST(o_orderkey AS VARCHAR)""",
    ),
}

# --- documents --------------------------------------------------------------------------------

# Unicode white space spelled out, as this dialect's \s is ASCII only.
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
EDGE = f"(^{SPACE})|({SPACE}$)"
NOT_WORD = r"[^\p{L}\p{N}_]"


def collapse(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{SPACE}', ' ', 'g'))"


def stripped(column: str) -> str:
    return f"regexp_replace({column}, '{EDGE}', '', 'g')"


def hit(column: str, *terms: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), '(?i)(^|{NOT_WORD})(?:{'|'.join(terms)})($|{NOT_WORD})')"


def day(shift: str) -> str:
    return f"strftime(CAST(o_orderdate AS DATE) + CAST({shift} AS INTEGER), '%Y-%m-%d')"


BOILERPLATE = [
    "sign up to (our|the) [^.?!]{0,120}",
    "subscribe [^.?!]{0,120}",
    "read more[: ]?",
    "image: [^.?!]{0,120}",
    "share your email [^.?!]{0,120}",
    "watch more of our videos [^.?!]{0,120}",
    "visit shots! now",
    "licensed? [^.?!]{0,120}",
]


def snippet(column: str) -> str:
    out = collapse(column)
    for pattern in BOILERPLATE:
        out = f"regexp_replace({out}, '(?i){pattern}', '', 'g')"
    return f"trim(regexp_replace({out}, '{SPACE}', ' ', 'g'), ' -:;,.')"


def sentence(column: str) -> str:
    """First sentence of an already cleaned column."""
    head = f"(CASE WHEN regexp_matches({column}, '[.!?] ') THEN regexp_extract({column}, '(?s)^(.*?[.!?]) ', 1) ELSE {column} END)"
    return f"""CASE WHEN length({head}) BETWEEN 40 AND 220 THEN {head} WHEN length({column}) <= 220 THEN {column}
        ELSE rtrim(substr({column}, 1, 217)) || '...' END"""


RAW: Chain = [
    (
        "raw",
        f"""SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS unique_article_id, text AS article_text,
        source AS domain, url AS resolved_url, CASE WHEN d.doc_id % 7 <> 0 THEN lang END AS article_author,
        CASE WHEN o_orderstatus = 'F' THEN {day("(o_custkey % 900) - 450")}
             WHEN d.doc_id % 13 = 0 THEN 'not a date' END AS article_date,
        CASE WHEN d.doc_id % 5 <> 0 THEN 'a' || d.doc_id END AS article_id,
        CASE WHEN n_chars % 2 = 0 THEN 'g' || (d.doc_id // 100 * 20 + d.doc_id % 20)
          || CASE WHEN d.doc_id % 3 = 0 THEN chr(10) ELSE '' END END AS duplicate_group,
        CASE WHEN o_orderpriority = '1-URGENT' THEN {day("3")} || '; ' || {day("0")}
             WHEN o_orderpriority = '5-LOW' THEN {day("0")} || ' 10:30:00'
             WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%a %b %d 10:30:00 +0000 %Y')
             WHEN d.doc_id % 11 = 0 THEN chr(9) || strftime(o_orderdate, '%d %b %Y') || chr(160) || chr(10)
             WHEN d.doc_id % 31 <> 0 THEN {day("0")} END AS tweet_date,
        CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS TIMESTAMP)
             WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN o_orderdate + INTERVAL 630 MINUTE
             WHEN d.doc_id % 11 = 0 OR d.doc_id % 31 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS tweet_ts,
        lang AS "LAD", CASE WHEN d.doc_id % 29 = 0 THEN chr(160) || chr(9) || ' '
             WHEN d.doc_id % 17 <> 0 THEN chr(9) || source || chr(160) || chr(10) END AS "main_LAD", source AS owner
        FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id LEFT JOIN orders o
        ON o.o_orderkey = d.doc_id // 100 * 20 + d.doc_id % 20""",
    ),
    (
        "parsed",
        f"""SELECT *, TRY_CAST(article_date AS TIMESTAMP) AS article_ts,
        coalesce(contains(tweet_date, ';'), false) AS has_multi_tweet,
        {stripped("""coalesce("main_LAD", "LAD", '')""")} AS region, {collapse("article_text")} AS text_clean,
        {stripped("coalesce(duplicate_group, article_id, unique_article_id)")} AS story_key FROM raw""",
    ),
    (
        "dated",
        """SELECT *, article_ts IS NOT NULL AND (tweet_ts IS NULL OR
          abs(epoch(article_ts) - epoch(tweet_ts)) <= 365 * 86400) AS by_article FROM parsed""",
    ),
    (
        "judged",
        """SELECT *, CASE WHEN by_article THEN article_ts ELSE tweet_ts END AS d,
        CASE WHEN by_article THEN 'article_date' ELSE 'tweet_date' END AS date_source,
        CAST(length(text_clean) AS INTEGER) AS text_len FROM dated""",
    ),
    (
        "reasons",
        """SELECT *, text_len < 200 AS short, d IS NULL AS no_date, region = '' AS no_region,
        coalesce(d < TIMESTAMP '1996-01-01' OR d > TIMESTAMP '2000-12-31', false) AS outlier,
        CAST(date_trunc('week', d) AS DATE) AS "week" FROM judged""",
    ),
    ("kept", "SELECT * FROM reasons WHERE NOT (short OR no_date OR no_region OR outlier)"),
    (
        "groups",
        'SELECT story_key, region, "week", count(*) AS group_rows FROM kept GROUP BY story_key, region, "week"',
    ),
    (
        "weighted",
        """SELECT k.*, 1.0::DOUBLE / group_rows AS dup_weight FROM kept k JOIN groups g
        ON k.story_key = g.story_key AND k.region = g.region AND k."week" = g."week" """,
    ),
    (
        "hits",
        f"""SELECT *, {hit("text_clean", "license", "copyright", "und der")} AS strong_keyword_hit,
        {hit("text_clean", "that", "with", "avec", "que")} AS weak_keyword_hit,
        {hit("resolved_url", "en", "blog")} AS url_section_hit FROM weighted""",
    ),
    (
        "flagged",
        """SELECT *, strong_keyword_hit OR weak_keyword_hit OR url_section_hit AS is_candidate,
        CASE WHEN strong_keyword_hit THEN 'strong_keyword'
             WHEN weak_keyword_hit AND url_section_hit THEN 'weak_keyword+url_section'
             WHEN weak_keyword_hit THEN 'weak_keyword' WHEN url_section_hit THEN 'url_section' ELSE '' END
          AS candidate_source FROM hits""",
    ),
    ("cand", "SELECT * FROM flagged WHERE is_candidate"),
]

DOC_STORY: Chain = RAW + [
    (
        "buckets",
        """SELECT story_key, region, "week", count(*) AS article_rows FROM cand GROUP BY story_key, region, "week" """,
    ),
    STORY[len(ARTICLES) + 1],
    STORY[len(ARTICLES) + 2],
    (
        "meta",
        """SELECT p.story_key, p.region, p."week", region_spread, n.article_rows, f."LAD",
        CASE WHEN f.strong_keyword_hit THEN 'strong' ELSE 'weak_url' END AS sampling_tier,
        f.text_clean AS text_for_embedding
        FROM prim p JOIN first f USING (story_key) JOIN (SELECT story_key, count(*) AS article_rows,
          CAST(count(DISTINCT region) AS INTEGER) AS region_spread FROM cand GROUP BY story_key) n USING (story_key)""",
    ),
]

DOC_INDEX: Chain = (
    DOC_STORY
    + [
        (
            "scored",
            """SELECT c.unique_article_id, c.story_key, c."week", c.region, c.resolved_url, c.text_clean,
        m.region_spread, true AS is_econ, dup_weight / sqrt(m.region_spread) AS effective_weight,
        CASE WHEN m."LAD" IN ('en', 'fr', 'de') THEN m."LAD" ELSE 'other_econ' END AS assigned_topic,
        0.5::DOUBLE + ((m.article_rows * 37 + m.region_spread * 11) % 100) / 500.0::DOUBLE AS top1_similarity
        FROM cand c JOIN meta m USING (story_key)""",
        ),
        ("weighed", "SELECT * FROM scored"),
    ]
    + panel_chain(["en", "fr", "de", "other_econ"])
    + output_chain(1999, 1998)
)

DAYTIME = "'%Y-%m-%d %H:%M:%S'"

MISSING = [
    "unique_article_id", "article_text", "domain", "resolved_url", "article_author", "article_date", "article_id",
    "duplicate_group", "tweet_date", "LAD", "main_LAD", "owner",
]
ABSENT = [
    "twitter", "twitter_id", "tweet_url", "retweet_count", "reply_count", "like_count", "quote_count",
    "impression_count",
]

ORACLES |= {
    "clean_text": f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS text_len
        FROM (SELECT doc_id, {collapse("text")} AS t FROM documents)""",
    "clean_page_text": f"""SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS text_len
        FROM (SELECT page_id, {collapse("html")} AS t FROM pages)""",
    "text_prefix": f"SELECT doc_id, substr({collapse('text')}, 1, 1200) AS text_for_embedding FROM documents",
    "region_coalesce": build(RAW, "SELECT unique_article_id, region FROM parsed"),
    "story_key": build(RAW, "SELECT unique_article_id, story_key FROM parsed"),
    "multi_date_min": f"""SELECT event_id, event_id % 3 = 0 AS has_multi_tweet,
        strftime(date_trunc('second', CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END), {DAYTIME})
          AS parsed FROM events""",
    "primary_date": build(
        RAW,
        f"SELECT unique_article_id, strftime(d, {DAYTIME}) AS \"date\", date_source, has_multi_tweet FROM judged",
    ),
    "week_start": """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS "week" FROM orders""",
    "keep_filter": build(
        RAW, 'SELECT unique_article_id, story_key, region, "week", text_len, date_source FROM kept'
    ),
    "cleaned_articles": build(
        RAW,
        f"""SELECT unique_article_id, story_key, region, "week", text_len, has_multi_tweet, {r6("dup_weight")},
        strftime(d, {DAYTIME}) AS "date", md5(text_clean) AS digest FROM weighted""",
    ),
    "cleaning_counters": build(
        RAW,
        f"""SELECT count(*) AS rows_seen, (SELECT count(*) FROM kept) AS rows_kept,
        count(*) FILTER (WHERE short) AS rows_dropped_short_text,
        count(*) FILTER (WHERE outlier) AS rows_dropped_date_outlier,
        count(*) FILTER (WHERE no_date) AS rows_dropped_missing_date,
        count(*) FILTER (WHERE no_region) AS rows_dropped_missing_region,
        count(*) FILTER (WHERE has_multi_tweet) AS multi_tweet_rows,
        (SELECT strftime(min(d), {DAYTIME}) FROM kept) AS clean_date_min,
        (SELECT strftime(max(d), {DAYTIME}) FROM kept) AS clean_date_max FROM reasons""",
    ),
    "missing_share": build(
        RAW,
        " UNION ALL ".join(
            [
                f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" IS NULL) AS missing_rows,
        round(count(*) FILTER (WHERE "{c}" IS NULL) / count(*), 6) + 0.0 AS missing_share FROM raw"""
                for c in MISSING
            ]
            + [
                f"SELECT '{c}', count(*), 1.0::DOUBLE FROM raw"
                for c in ABSENT
            ]
        ),
    ),
    "top_region_counts": build(
        RAW, 'SELECT region, count(*) AS "rows" FROM kept GROUP BY region ORDER BY count(*) DESC, region LIMIT 15'
    ),
    "example_rows": build(
        RAW,
        f"""SELECT unique_article_id, strftime(d, {DAYTIME}) AS "date", region, text_len,
        substr(article_text, 1, 220) AS raw_preview, substr(text_clean, 1, 220) AS clean_preview
        FROM kept ORDER BY d, unique_article_id LIMIT 10""",
    ),
    "cleaning_report": build(
        RAW,
        """SELECT CAST(200 AS BIGINT) AS text_min_length, count(*) AS rows_seen, (SELECT count(*) FROM kept) AS rows_kept,
        (SELECT count(*) FROM groups) AS duplicate_story_groups,
        round(count(*) FILTER (WHERE resolved_url IS NULL) / count(*), 6) + 0.0 AS missing_url_share,
        (SELECT region FROM kept GROUP BY region ORDER BY count(*) DESC, region LIMIT 1) AS top_region,
        (SELECT count(*) FROM kept GROUP BY region ORDER BY count(*) DESC, region LIMIT 1) AS top_region_rows,
        (SELECT unique_article_id FROM kept ORDER BY d, unique_article_id LIMIT 1) AS first_example FROM raw""",
    ),
    "region_value_counts": build(RAW, 'SELECT region, count(*) AS "rows" FROM kept GROUP BY region'),
    "text_length_profile": build(
        RAW,
        f"""SELECT "count", {r6("mean", "std", "min", "p25", "p50", "p75", "max")} FROM (SELECT count(*) AS "count",
        avg(text_len) AS mean, stddev_samp(text_len) AS std, min(text_len)::DOUBLE AS "min",
        quantile_cont(text_len, 0.25) AS p25, quantile_cont(text_len, 0.5) AS p50, quantile_cont(text_len, 0.75) AS p75,
        max(text_len)::DOUBLE AS "max" FROM kept)""",
    ),
    # kind 10 is month first wherever that is a date, so days up to 12 change places with the month
    "parse_mixed_dates": f"""SELECT o_orderkey, strftime(CASE o_orderkey % 14 WHEN 0 THEN o_orderdate
        WHEN 1 THEN o_orderdate - INTERVAL 2 HOUR WHEN 2 THEN o_orderdate WHEN 3 THEN o_orderdate
        WHEN 6 THEN o_orderdate + INTERVAL 73164 SECOND WHEN 7 THEN o_orderdate WHEN 8 THEN o_orderdate
        WHEN 9 THEN o_orderdate + INTERVAL 10 HOUR
        WHEN 10 THEN CASE WHEN day(o_orderdate) <= 12
          THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) ELSE o_orderdate END
        WHEN 11 THEN o_orderdate + INTERVAL 9 HOUR WHEN 12 THEN o_orderdate + INTERVAL 15 HOUR WHEN 13 THEN o_orderdate
        END, {DAYTIME}) AS parsed FROM orders""",
    "keyword_flags": build(
        RAW,
        """SELECT unique_article_id, strong_keyword_hit, weak_keyword_hit, url_section_hit, is_candidate
        FROM flagged""",
    ),
    "candidate_source": build(RAW, "SELECT unique_article_id, candidate_source FROM cand"),
    "candidate_summary": build(
        RAW,
        """SELECT count(*) AS total_cleaned_rows, count(*) FILTER (WHERE is_candidate) AS candidate_rows,
        count(DISTINCT CASE WHEN is_candidate THEN story_key END) AS unique_candidate_story_keys,
        count(*) FILTER (WHERE candidate_source = 'strong_keyword') AS candidate_source__strong_keyword,
        count(*) FILTER (WHERE candidate_source = 'weak_keyword') AS candidate_source__weak_keyword,
        count(*) FILTER (WHERE candidate_source = 'url_section') AS candidate_source__url_section,
        count(*) FILTER (WHERE candidate_source = 'weak_keyword+url_section')
          AS "candidate_source__weak_keyword+url_section" FROM flagged""",
    ),
    "stratified_review_sample": build(
        RAW,
        f"""SELECT candidate_source, unique_article_id, strftime(d, {DAYTIME}) AS "date", "week", region, resolved_url,
        strong_keyword_hit, weak_keyword_hit, url_section_hit, md5(text_clean) AS text_clean FROM (SELECT *,
        row_number() OVER (PARTITION BY candidate_source ORDER BY sha256('42::' || unique_article_id),
        unique_article_id) AS rn FROM cand) WHERE rn <= 5""",
    ),
    "candidate_profile": build(
        RAW,
        f"""SELECT candidate_rows, unique_regions, unique_weeks,
        {r6("share_strong_keyword", "share_weak_keyword", "share_url_section")} FROM (SELECT count(*) AS candidate_rows,
        avg(CAST(strong_keyword_hit AS INTEGER)) AS share_strong_keyword,
        avg(CAST(weak_keyword_hit AS INTEGER)) AS share_weak_keyword,
        avg(CAST(url_section_hit AS INTEGER)) AS share_url_section,
        count(DISTINCT region) AS unique_regions, count(DISTINCT "week") AS unique_weeks FROM cand)""",
    ),
    "source_value_counts": build(RAW, 'SELECT candidate_source, count(*) AS "rows" FROM cand GROUP BY 1'),
    "url_keywords": f"SELECT page_id, {hit('url', 'en', 'blog')} AS url_section_hit FROM pages",
    "sampled_story_texts": build(
        DOC_STORY + sample_chain(100, 70),
        """SELECT story_key, region, "week", region_spread, 'dev' AS run_mode, sampling_tier,
        md5(text_for_embedding) AS digest FROM sample""",
    ),
    "snippet_clean": f"""SELECT doc_id, md5(c) AS digest, CAST(length(c) AS INTEGER) AS chars
        FROM (SELECT doc_id, {snippet("text")} AS c FROM documents)""",
    "first_sentence": f"""SELECT doc_id, {sentence("c")} AS representative_snippet
        FROM (SELECT doc_id, {snippet("text")} AS c FROM documents)""",
    "region_name_key": "SELECT s_suppkey, 'supplier''s ' || s_suppkey AS region_key FROM supplier",
    "document_index": build(DOC_INDEX, f"SELECT {PAIR} FROM idx"),
    "representative_snippets": build(
        DOC_INDEX
        + [
            (
                "snips",
                f"""SELECT s.*, l.topic, l.risk_score, l.n_articles, l.topic_share, {snippet("text_clean")} AS c
                FROM scored s JOIN latest l ON s."week" = l."week" AND s.region = l.region
                AND s.assigned_topic = l.topic""",
            ),
            ("told", f"SELECT *, {sentence('c')} AS representative_snippet FROM snips"),
            (
                "ranked",
                """SELECT *, CAST(row_number() OVER (PARTITION BY "week", region, topic ORDER BY top1_similarity DESC,
                region_spread, unique_article_id) AS INTEGER) AS snippet_rank FROM told
                WHERE representative_snippet <> ''""",
            ),
        ],
        f"""SELECT "week", region, topic, snippet_rank, unique_article_id, resolved_url, region_spread,
        representative_snippet, {r6("risk_score", "n_articles", "topic_share", "top1_similarity")}
        FROM ranked WHERE snippet_rank <= 3""",
    ),
    "outer_rings": """SELECT s_suppkey, CAST(i AS INTEGER) AS ring_index, CAST(4 AS INTEGER) AS points,
        round(CAST(s_suppkey + i * 100 + 1 AS DOUBLE), 6) AS second_x
        FROM supplier, (VALUES (0), (1)) v(i) WHERE (s_suppkey % 4 = 0 AND i = 0) OR s_suppkey % 4 = 1""",
    "boundary_join": """SELECT c_custkey AS place, ' SUPPLIER’S  ' || c_custkey AS "name",
        'supplier''s ' || c_custkey AS region_key,
        round(coalesce(q, 0), 6) + 0.0 AS risk_score FROM customer LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_suppkey = c_custkey""",
}

# --- vectors ----------------------------------------------------------------------------------

VECTORS: Chain = [
    (
        "st",
        """SELECT CAST(vec_id AS VARCHAR) AS story_key, embedding::DOUBLE[] AS e,
        coalesce(CASE label % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS strong_keyword_hit,
        CASE WHEN label % 2 = 0 THEN 'strong_keyword' ELSE 'url_section' END AS candidate_source,
        CAST(label % 4 + 1 AS INTEGER) AS region_spread FROM embeddings""",
    ),
    ("refs", "SELECT vec_id AS ref, embedding::DOUBLE[] AS r FROM embeddings WHERE vec_id < 16"),
    ("dots", "SELECT story_key, CAST(ref AS INTEGER) AS ref, list_dot_product(e, r) AS s FROM st CROSS JOIN refs"),
    (
        "maxes",
        """SELECT story_key, max(s) FILTER (WHERE ref < 4) AS pos_max,
        max(s) FILTER (WHERE ref BETWEEN 4 AND 8) AS neg_max FROM dots GROUP BY story_key""",
    ),
    (
        "order_t",
        """SELECT *, row_number() OVER (PARTITION BY story_key ORDER BY s DESC, ref) AS rn
        FROM dots WHERE ref >= 9""",
    ),
    (
        "tops",
        """SELECT story_key, max(CASE WHEN rn = 1 THEN 'topic_' || ref END) AS top_topic,
        max(CASE WHEN rn = 1 THEN s END) AS top1_similarity, max(CASE WHEN rn = 2 THEN s END) AS top2_similarity
        FROM order_t GROUP BY story_key""",
    ),
    (
        "gate",
        """SELECT *, ((pos_max >= 0.10 AND pos_max - neg_max >= 0.04) OR (strong_keyword_hit AND pos_max >= 0.05
          AND pos_max - neg_max >= -0.05)) AND NOT (neg_max > pos_max + 0.02) AS is_econ
        FROM st JOIN maxes USING (story_key) JOIN tops USING (story_key)""",
    ),
    (
        "told",
        """SELECT *, CASE WHEN NOT is_econ THEN 'unassigned' WHEN top1_similarity >= 0.15 THEN top_topic
          ELSE 'other_econ' END AS assigned_topic, top1_similarity - top2_similarity < 0.02 AS topic_ambiguous
        FROM gate""",
    ),
]

ORACLES |= {
    "vector_dot": build(
        VECTORS, "SELECT story_key, ref AS reference, round(s, 6) + 0.0 AS similarity FROM dots"
    ),
    "anchor_max": build(
        VECTORS,
        f"""SELECT story_key, {r6("pos_max", "neg_max", "econ_margin")}
        FROM (SELECT *, pos_max - neg_max AS econ_margin FROM maxes)""",
    ),
    "topic_argmax_top2": build(
        VECTORS, f'SELECT story_key, top_topic, {r6("top1_similarity", "top2_similarity")} FROM tops'
    ),
    "econ_gate": build(VECTORS, "SELECT story_key, is_econ FROM gate"),
    "assigned_topic": build(VECTORS, "SELECT story_key, is_econ, assigned_topic, topic_ambiguous FROM told"),
    "story_scores": build(
        VECTORS,
        """SELECT story_key, candidate_source, strong_keyword_hit, region_spread,
        round(pos_max, 6) + 0.0 AS econ_confidence, is_econ, top_topic,
        round(top1_similarity, 6) + 0.0 AS top1_similarity, topic_ambiguous, assigned_topic FROM told""",
    ),
    "review_group": build(
        VECTORS,
        """SELECT CASE assigned_topic WHEN 'unassigned' THEN 'rejected_candidate' WHEN 'other_econ' THEN 'other_econ'
        ELSE 'boe_topic' END AS review_group, count(*) AS "rows" FROM told GROUP BY 1""",
    ),
    "l2_normalize": """SELECT vec_id, CAST(i - 1 AS INTEGER) AS "position",
        round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS "value"
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v, unnest(range(1, 65)) AS i
        FROM embeddings)""",
    "vector_profile": """SELECT count(*) AS story_lookup_rows, count(embedding) AS embedding_rows,
        CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, 'dev' AS run_modes FROM embeddings""",
    "vector_parity": """SELECT doc_id AS story_key, 'vectors' AS missing_from FROM documents
        WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT vec_id, 'lookup' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
    "topic_profile_text": """SELECT p_type, p_type || chr(10) || 'Parts of type ' || p_type || chr(10) || 'Keywords: '
        || array_to_string(list_sort(list(DISTINCT p_brand)), ', ') || chr(10) || 'Seed examples: '
        || array_to_string(list_sort(list(DISTINCT 'Size ' || p_size || '.')), ' ') AS profile_text
        FROM part GROUP BY p_type""",
}


# --- maps by place ----------------------------------------------------------------------------


def by_place(table: str, value: str, default: str) -> str:
    shown = r6(value) if value == "risk_score" else value
    return line(
        f"""SELECT name, region_key, {shown} FROM (SELECT n.*, coalesce(t.{value}, {default}) AS {value} FROM
        (SELECT upper(n_name[1]) || lower(n_name[2:]) AS name, lower(n_name) AS region_key FROM nation) n
        LEFT JOIN {table} t ON lower(t.region) = n.region_key)"""
    )


TOP_RISK = "(SELECT region, top_risk_score AS risk_score FROM leaders)"
LABELS = """(SELECT region, CASE WHEN top_risk_score > 0 THEN top_topic ELSE 'No positive topic signal' END AS label
    FROM leaders)"""

ORACLES |= {
    "top_risk_map": line(f"SELECT region, top_topic, {r6('risk_score')} FROM (SELECT *, top_risk_score AS risk_score FROM leaders)"),
    "top_risk_legend": line(
        f"""SELECT region, top_topic, {r6('risk_score')} FROM (SELECT *, top_risk_score AS risk_score FROM leaders
        ORDER BY top_risk_score DESC, region LIMIT 8)"""
    ),
    "reference_map_places": by_place("rmap", "risk_score", "0"),
    "month_map_places": by_place("mmap", "risk_score", "0"),
    "top_risk_map_places": by_place(TOP_RISK, "risk_score", "0"),
    "leader_label_places": by_place(LABELS, "label", "'No positive topic signal'"),
}

# --- texts as vectors -------------------------------------------------------------------------


def encoded(source: str, key: str, column: str) -> Chain:
    """Steps `<source>_cells` (key, pos, v): unit vectors of hashed word counts."""
    return [
        (
            f"{source}_words",
            rf"""SELECT {key}, unnest(string_split_regex(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+')) AS word
            FROM {source}""",
        ),
        (
            f"{source}_counts",
            f"""SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % 512 AS pos, count(*) AS n FROM {source}_words
            WHERE word <> '' GROUP BY ALL""",
        ),
        (
            f"{source}_cells",
            f"SELECT {key}, pos, n / sqrt(sum(n * n) OVER (PARTITION BY {key})::DOUBLE) AS v FROM {source}_counts",
        ),
    ]


MODEL_TOPICS = {
    "open": ("the that with", "license, copyright", "the license with that"),
    "plain": ("and of the in", "that, the", "the thing that this"),
    "mixed": ("que les der und", "avec, und", "que la der sch"),
}
MODEL_TEXTS = [
    ("p", "", "the that with and this for"), ("p", "", "license copyright notice"),
    ("n", "", "le la les aux des queux"), ("n", "", "und der die das sch"),
    *[("t", name, f"{name} {d} Keywords: {k} Seed examples: {e}") for name, (d, k, e) in MODEL_TOPICS.items()],
]

DOC_MODEL: Chain = (
    DOC_STORY
    + [
        (
            "refs",
            "SELECT * FROM (VALUES "
            + ", ".join(f"({i}, '{kind}', '{name}', '{words}')" for i, (kind, name, words) in enumerate(MODEL_TEXTS))
            + ") t(ref, kind, topic, words)",
        )
    ]
    + encoded("meta", "story_key", "text_for_embedding")
    + encoded("refs", "ref", "words")
    + [
        (
            "dots",
            """SELECT m.story_key, r.ref, coalesce(s, 0) AS s FROM meta m CROSS JOIN refs r LEFT JOIN (
              SELECT story_key, ref, sum(a.v * b.v) AS s FROM meta_cells a JOIN refs_cells b ON a.pos = b.pos
              GROUP BY story_key, ref) d ON d.story_key = m.story_key AND d.ref = r.ref""",
        ),
        (
            "best",
            """SELECT story_key, max(s) FILTER (WHERE kind = 'p') AS pos_max, max(s) FILTER (WHERE kind = 'n') AS neg_max,
            list(s ORDER BY s DESC, ref) FILTER (WHERE kind = 't') AS ss,
            list(topic ORDER BY s DESC, ref) FILTER (WHERE kind = 't') AS ts
            FROM dots JOIN refs USING (ref) GROUP BY story_key""",
        ),
        ("strong", "SELECT story_key, bool_or(strong_keyword_hit) AS strong_keyword_hit FROM cand GROUP BY story_key"),
        (
            "gate",
            """SELECT *, ((pos_max >= 0.05 AND pos_max - neg_max >= 0.01)
              OR (strong_keyword_hit AND pos_max >= 0.02 AND pos_max - neg_max >= 0)) AND NOT (neg_max > pos_max + 0.02) AS is_econ
            FROM best JOIN strong USING (story_key) JOIN (SELECT story_key, region_spread FROM meta) USING (story_key)""",
        ),
        (
            "told",
            """SELECT story_key, strong_keyword_hit, region_spread, pos_max AS econ_confidence, is_econ, ts[1] AS top_topic,
            ss[1] AS top1_similarity, ss[1] - ss[2] < 0.02 AS topic_ambiguous,
            CASE WHEN NOT is_econ THEN 'unassigned' WHEN ss[1] >= 0.05 THEN ts[1] ELSE 'other_econ' END AS assigned_topic
            FROM gate""",
        ),
        (
            "weighed",
            """SELECT c."week", c.region, t.is_econ, t.assigned_topic, t.top1_similarity,
            dup_weight / sqrt(t.region_spread) AS effective_weight FROM cand c JOIN told t USING (story_key)""",
        ),
    ]
    + panel_chain([*MODEL_TOPICS, "other_econ"])
    + output_chain(1999, 1998)
)

ORACLES |= {
    "embed_text": build(
        encoded("documents", "doc_id", "text"),
        f"SELECT doc_id, CAST(pos AS INTEGER) AS position, {r6('value')} FROM (SELECT doc_id, pos, v AS value FROM documents_cells)",
    ),
    "end_to_end_scores": build(
        DOC_MODEL,
        f"""SELECT story_key, strong_keyword_hit, region_spread, {r6("econ_confidence", "top1_similarity")}, is_econ, top_topic,
        topic_ambiguous, assigned_topic FROM told""",
    ),
    "end_to_end_pairs": build(
        DOC_MODEL,
        f"""SELECT {PAIR}, 'reference_week' AS "window" FROM latest
        UNION ALL SELECT {PAIR}, 'recent_active_weeks' FROM rolling""",
    ),
    "stage_losses": build(
        RAW,
        """SELECT 'articles' AS stage, count(*) AS rows_in, count(*) AS rows_out, CAST(0 AS BIGINT) AS lost FROM cand
        UNION ALL SELECT 'stories', count(DISTINCT story_key), count(DISTINCT story_key), 0 FROM cand""",
    ),
    "csv_round_trip": build(
        RAW,
        """SELECT unique_article_id, 'says "x, y"' || chr(10) || 'and more' AS article_author, duplicate_group, "LAD",
        CAST(length(article_text) AS INTEGER) AS chars FROM raw""",
    ),
    "limited_rows": build(
        RAW, """SELECT unique_article_id, "LAD", CAST(length(article_text) AS INTEGER) AS chars FROM raw ORDER BY unique_article_id LIMIT 40"""
    ),
    "result_read_back": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) + 0.0 AS price,
        starts_with(o_orderpriority, '1') AS urgent, ' "' || o_orderpriority || '",' || chr(10) || o_orderstatus || chr(92) || ' ' AS note,
        CAST(NULL AS VARCHAR) AS nothing FROM orders""",
    "vector_round_trip": """SELECT vec_id AS story_key, label, CAST(len(embedding) AS INTEGER) AS components,
        round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS total,
        round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings""",
    "stage_guards": """SELECT 'orders' AS stage, (SELECT count(*) FROM orders) = 0 AS stopped
        UNION ALL SELECT 'orders without a price', (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0
        UNION ALL SELECT 'urgent orders', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') = 0
        UNION ALL SELECT 'orders of no customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0""",
    "parquet_round_trip": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders",
    "json_round_trip": "SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS size FROM part",
    "geojson_round_trip": """SELECT 'supplier''s ' || s_suppkey AS region_key, CAST(i AS INTEGER) AS ring_index,
        CAST(4 AS INTEGER) AS points FROM supplier, (VALUES (0), (1)) v(i)
        WHERE (s_suppkey % 4 = 0 AND i = 0) OR s_suppkey % 4 = 1""",
    "ordered_preview": """SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders
        ORDER BY o_totalprice, o_orderkey LIMIT 25""",
}
