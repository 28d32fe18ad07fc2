"""Queries over generated texts: lexical measures, jobs, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning, reports
from ..operators.lexical import lexical_summary, measures
from ..sources.tables import table
from . import sql as S


def generations(spark: SparkSession, folder: str) -> DataFrame:
    """Generation records, each whole row once."""
    return table(spark, folder, "generation_samples").drop("token_ids").distinct()


def lexical_overall(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_summary(generations(spark, folder), {"all_records": F.lit("all")})


def lexical_by_preset(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_summary(generations(spark, folder), {"preset": F.col("preset")})


def lexical_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_summary(generations(spark, folder), {"category": F.col("category")})


def lexical_measures(spark: SparkSession, folder: str) -> DataFrame:
    rows = measures(generations(spark, folder).select("completion").distinct())
    return rows.select(F.md5("completion").alias("text_md5"), F.size("_words").alias("words"), F.round("repeated_4gram", 9).alias("repeated_4gram"), F.round("sentence_repetition", 9).alias("sentence_repetition"))


def grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Two independent groupings of one scan, told apart by the grouping id."""
    generations(spark, folder).createOrReplaceTempView("_generations")
    return spark.sql(
        """SELECT CASE grouping_id(preset, category) WHEN 1 THEN 'preset' ELSE 'category' END AS grouping, coalesce(preset, category, 'None') AS value,
        count(*) AS generations, round(avg(new_tokens), 6) AS mean_new_tokens, round(avg(CAST(finished_with_eos AS DOUBLE)), 6) AS eos_rate
        FROM _generations GROUP BY GROUPING SETS ((preset), (category))"""
    )


def rating_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return reports.rating_sheet(generations(spark, folder))


def rubric_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = generations(spark, folder)
    return rows.select(reports.item_id("prompt_id", "preset", "seed").alias("item_id"), F.md5(reports.judge_prompt(F.col("prompt"), F.col("completion"))).alias("prompt_md5"))


def rubric_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a fixed rule in place of a judge: 10 minus ten times each text's repetition."""
    rows = measures(generations(spark, folder)).select(
        F.create_map(F.lit("phrases"), F.round(10 - 10 * F.col("repeated_4gram"), 6), F.lit("sentences"), F.round(10 - 10 * F.col("sentence_repetition"), 6)).alias("scores")
    )
    return reports.rubric_summary(rows)


def judge_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores read from answers of a judge, one JSON text for each generation. A rule stands for the judge; answers to
    empty completions are no JSON, and of the others every criterion has a score and a reason."""
    length = F.char_length("completion")
    part = lambda c, k: F.concat(F.lit(f'"{c}": {{"score": '), (F.pmod(length + k, F.lit(10)) + 1).cast("string"), F.lit(', "justification": "'), length.cast("string"), F.lit(' \\"characters\\""}'))
    answer = F.when(length > 0, F.concat(F.lit("{"), part("grammar", 0), F.lit(", "), part("plot", 3), F.lit("}"))).otherwise(F.lit("no answer"))
    rows = generations(spark, folder).select(reports.item_id("prompt_id", "preset", "seed").alias("item_id"), reports.parse_judgement(answer).alias("judged"))
    return rows.select("item_id", F.explode_outer("judged").alias("criterion", "found")).select("item_id", "criterion", "found.score", "found.justification")


def job_enumeration(spark: SparkSession, folder: str) -> DataFrame:
    presets = generations(spark, folder).where("preset is not null").groupBy("preset").agg(F.max("settings.do_sample").alias("do_sample"))
    seeds = generations(spark, folder).where("seed is not null").select("seed").distinct()
    return planning.generation_jobs(table(spark, folder, "prompts"), presets, seeds)


def pending_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return planning.pending_jobs(job_enumeration(spark, folder), generations(spark, folder))


def context_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = generations(spark, folder).select("prompt_id", "prompt", "prompt_tokens").where("prompt_tokens is not null").distinct()
    return planning.fits_context(rows, "prompt_tokens", 24).select("prompt_id", F.md5("prompt").alias("prompt_md5"), "fits", "reason")


def duplicate_prompt_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "prompts").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def prompt_groups(spark: SparkSession, folder: str) -> DataFrame:
    group = F.coalesce("prompt_group", F.lit("None"))
    return table(spark, folder, "prompts").groupBy("category", group.alias("prompt_group")).agg(F.count("*").alias("prompts"), F.count("expected").alias("with_expected"))


def settings_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of the balanced preset that differ from greedy decoding."""
    from ..operators.tracking import config_diff, flatten_struct

    flat = flatten_struct(generations(spark, folder).where("preset in ('greedy', 'balanced')"), "settings", ["preset"]).groupBy("preset", "key").agg(F.min("value").alias("value"))
    return config_diff(flat.where("preset = 'greedy'"), flat.where("preset = 'balanced'"), ("use_cache",))


def first_completion(spark: SparkSession, folder: str) -> DataFrame:
    """The first completion of each prompt and preset, by seed and text."""
    rows = generations(spark, folder).where("prompt_id is not null")
    return rows.groupBy("prompt_id", "preset").agg(F.min(F.struct("seed", "completion")).alias("f")).select("prompt_id", "preset", "f.seed", F.md5("f.completion").alias("completion_md5"))


_G = "g AS (SELECT DISTINCT * EXCLUDE (token_ids) FROM generation_samples)"
_SENT = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(completion, '^{S.BLANK}+|{S.BLANK}+$', '', 'g'), '([.!?]){S.BLANK}+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: array_to_string({S.words('s')}, ' ')), lambda s: s <> '')"
_M = f"""{_G}, w AS (SELECT *, {S.words("completion")} AS ws, {_SENT} AS ss FROM g WHERE completion IS NOT NULL),
m AS (SELECT *, {S.grams("ws", 4)} AS q FROM w),
me AS (SELECT *, CASE WHEN len(q) > 0 THEN (len(q) - len(list_distinct(q))) / len(q) ELSE 0.0 END AS r4, CASE WHEN len(ss) >= 2 THEN (len(ss) - len(list_distinct(ss))) / len(ss) ELSE 0.0 END AS rs FROM m)"""


def _lexical(key: str, name: str) -> str:
    return f"""WITH {_M}, k AS (SELECT *, {key} AS gk FROM me),
d1 AS (SELECT gk, count(DISTINCT x) / count(*) AS d FROM (SELECT gk, unnest(ws) AS x FROM k) GROUP BY gk),
d2 AS (SELECT gk, count(DISTINCT x) / count(*) AS d FROM (SELECT gk, unnest({S.grams("ws", 2)}) AS x FROM k) GROUP BY gk)
SELECT k.gk AS {name}, count(*) AS generations, round(avg(len(ws)), 6) AS mean_words, round(avg(new_tokens), 6) AS mean_new_tokens, round(avg(finished_with_eos::INT::DOUBLE), 6) AS eos_rate,
coalesce(round(any_value(d1.d), 9), 0.0) AS distinct_1, coalesce(round(any_value(d2.d), 9), 0.0) AS distinct_2, round(avg(r4), 6) AS repeated_4gram_fraction, round(avg(rs), 6) AS sentence_repetition_ratio
FROM k LEFT JOIN d1 USING (gk) LEFT JOIN d2 USING (gk) GROUP BY k.gk"""


_JOBS = f"""{_G}, p AS (SELECT preset, bool_or(settings.do_sample) AS s FROM g WHERE preset IS NOT NULL GROUP BY preset), sd AS (SELECT DISTINCT seed FROM g WHERE seed IS NOT NULL),
jobs AS (SELECT prompts.id AS prompt_id, preset, seed FROM prompts, p, sd WHERE s OR seed = (SELECT min(seed) FROM sd))"""
_SETTING = lambda k: f"SELECT preset, '{k}' AS key, min(settings.{k}::VARCHAR) AS value FROM g WHERE preset IN ('greedy', 'balanced') GROUP BY preset"
_KEYS = ("do_sample", "temperature", "top_p", "top_k", "repetition_penalty", "max_new_tokens", "prepend_bos")

QUERIES = {
    "lexical_overall": (lexical_overall, _lexical("'all'", "all_records")),
    "lexical_by_preset": (lexical_by_preset, _lexical("coalesce(preset, 'None')", "preset")),
    "lexical_by_category": (lexical_by_category, _lexical("coalesce(category, 'None')", "category")),
    "lexical_measures": (lexical_measures, f"WITH {_M} SELECT DISTINCT md5(completion) AS text_md5, len(ws)::INT AS words, round(r4, 9) AS repeated_4gram, round(rs, 9) AS sentence_repetition FROM me"),
    "lexical_grouping_sets": (grouping_sets, f"WITH {_G} SELECT CASE grouping(preset, category) WHEN 1 THEN 'preset' ELSE 'category' END AS grouping, coalesce(preset, category, 'None') AS value, count(*) AS generations, round(avg(new_tokens), 6) AS mean_new_tokens, round(avg(finished_with_eos::INT::DOUBLE), 6) AS eos_rate FROM g GROUP BY GROUPING SETS ((preset), (category))"),
    "rating_sheet": (rating_sheet, f"WITH {_G} SELECT concat_ws('|', prompt_id, preset, seed::VARCHAR) AS item_id, category, prompt, completion, '' AS grammar, '' AS coherence, '' AS creativity, '' AS consistency, '' AS plot FROM g"),
    "rubric_prompts": (rubric_prompts, f"WITH {_G} SELECT concat_ws('|', prompt_id, preset, seed::VARCHAR) AS item_id, md5('Rate the continuation from 1 to 10 for: grammar, coherence, creativity, consistency, plot.' || chr(10) || chr(10) || 'Prompt: ' || prompt || chr(10) || chr(10) || 'Continuation: ' || completion) AS prompt_md5 FROM g"),
    "rubric_aggregate": (rubric_aggregate, f"WITH {_M}, s AS (SELECT 'phrases' AS criterion, round(10 - 10 * r4, 6) AS score FROM me UNION ALL SELECT 'sentences', round(10 - 10 * rs, 6) FROM me) SELECT criterion, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0.0), 6) AS std, count(score) AS n FROM s GROUP BY criterion"),
    "judge_scores": (
        judge_scores,
        f"WITH {_G}, a AS (SELECT concat_ws('|', prompt_id, preset, seed::VARCHAR) AS item_id, length(completion) AS n FROM g) SELECT item_id, criterion, CASE WHEN n > 0 THEN ((n + k) % 10 + 1)::DOUBLE END AS score, CASE WHEN n > 0 THEN n || ' \"characters\"' END AS justification FROM (SELECT item_id, n, unnest(CASE WHEN n > 0 THEN ['grammar', 'plot'] ELSE [NULL] END) AS criterion, unnest(CASE WHEN n > 0 THEN [0, 3] ELSE [0] END) AS k FROM a)",
    ),
    "job_enumeration": (job_enumeration, f"WITH {_JOBS} SELECT prompt_id, preset, seed FROM jobs"),
    "pending_jobs": (pending_jobs, f"WITH {_JOBS} SELECT prompt_id, preset, seed FROM jobs EXCEPT SELECT prompt_id, preset, seed FROM g"),
    "context_fit": (context_fit, f"WITH {_G} SELECT DISTINCT prompt_id, md5(prompt) AS prompt_md5, prompt_tokens + 1 < 24 AS fits, CASE WHEN NOT prompt_tokens + 1 < 24 THEN 'prompt has ' || prompt_tokens || ' tokens, context 24' END AS reason FROM g WHERE prompt_tokens IS NOT NULL"),
    "duplicate_prompt_ids": (duplicate_prompt_ids, "SELECT id, count(*) AS n FROM prompts GROUP BY id HAVING count(*) > 1"),
    "prompt_groups": (prompt_groups, "SELECT category, coalesce(prompt_group, 'None') AS prompt_group, count(*) AS prompts, count(expected) AS with_expected FROM prompts GROUP BY 1, 2"),
    "settings_diff": (settings_diff, f"WITH {_G}, f AS ({' UNION ALL '.join(map(_SETTING, _KEYS))}), o AS (SELECT * FROM f WHERE preset = 'greedy'), n AS (SELECT * FROM f WHERE preset = 'balanced') SELECT key, o.value AS old, n.value AS new FROM o FULL JOIN n USING (key) WHERE o.value IS DISTINCT FROM n.value"),
    "first_completion": (first_completion, f"WITH {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, preset ORDER BY seed NULLS FIRST, completion COLLATE C NULLS FIRST) AS p FROM g WHERE prompt_id IS NOT NULL) SELECT prompt_id, preset, seed, md5(completion) AS completion_md5 FROM r WHERE p = 1"),
}
