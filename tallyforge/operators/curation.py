"""Curation of a training table: duplicates, exclusions, flags, splits, the difficulty band, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scaffold, text

#: The nested table: prompts as messages, all else about a row in extra_info.
TRAINING_ROW = "data_source string, prompt array<struct<role:string,content:string>>, ability string, reward_model struct<style:string,ground_truth:string>, extra_info struct<index:bigint,split:string,task_tag:string,rubric_profile:string,rubrics:array<struct<criterion:string,points:double,tags:map<string,string>>>,variant_type:string,instance_id:string,exec_backend:string,harness:string,p_hat:double,p_hat_source:string,difficulty_0_10:double,difficulty_band:string,n_f2p:bigint,n_p2p:bigint,n_tests:bigint,context_bucket:string,lang:string,image_name:string,repo:string>"


def exploded(rows: DataFrame, struct: str = "extra_info") -> DataFrame:
    """rows with the struct's fields as columns."""
    return rows.select(*[c for c in rows.columns if c != struct], f"{struct}.*")


def prompt_text(prompt: Column) -> Column:
    """The messages as JSON: this engine's canonical form (compact, nulls left out), so hashes of it are its own."""
    return F.to_json(prompt)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, in columns by name; those that a frame lacks are null."""
    out, *rest = frames
    for f in rest:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_seen(rows: DataFrame, key: Column, position: str, item: str) -> DataFrame:
    """rows with dup_of: the item of the row with the same key that comes first by position, null for that row itself. The first is found by an aggregate, so a key that most rows share makes no large task. A null key is a key like others, and no text equals it."""
    hashed = rows.withColumn("_tf_key", F.coalesce(text.sha16(key), F.lit("")))
    first = hashed.groupBy("_tf_key").agg(F.min(F.struct(F.col(position).alias("p"), F.col(item).alias("i"))).alias("_tf_first"))
    joined = hashed.join(first, "_tf_key")
    return joined.withColumn("dup_of", F.when(F.col(position) != F.col("_tf_first.p"), F.col("_tf_first.i"))).drop("_tf_key", "_tf_first")


def first_reason(*cases: tuple[Column, Column | str]) -> Column:
    """The reason of the first case that holds, else an empty string."""
    return F.coalesce(*[F.when(when, why) for when, why in cases], F.lit(""))


def flag_list(*cases: tuple[Column, Column | str]) -> Column:
    """The flags of all cases that hold, in order."""
    return F.array_compact(F.array(*[F.when(when, flag) for when, flag in cases]))


def size_of(c: str) -> Column:
    return F.greatest(F.size(F.col(c)), F.lit(0))


def repo_decision(max_prompt_tokens: int = 30_000) -> tuple[Column, Column]:
    """(reason, flags) of repository tasks. Columns: dup_of, variant_type, prompt_tokens, judge_verdict and v, the validation record (null if there is none): extract_ok, gold_touches_tests, gold_needs_ignore_ws, gold, empty (structs ran, n_f2p, apply, log_tail, err_kind), f2p_effective, f2p_dropped, p2p_dropped."""
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    tests = true("v.gold_touches_tests")
    known = F.col("v").isNotNull()
    too_long = F.coalesce(F.col("prompt_tokens") > max_prompt_tokens, F.col("variant_type") != "swe_32k") & F.lit(max_prompt_tokens > 0)
    passes_empty = true("v.empty.ran") & (F.coalesce("v.empty.n_f2p", F.lit(0)) > 0)
    unapplied = F.coalesce(F.col("v.gold.apply") == "patch_apply_fail", F.lit(False))
    missing_file = F.coalesce(F.col("v.gold.log_tail"), F.lit("")).contains("No such file")
    usable = known & true("v.extract_ok") & ~passes_empty & ~unapplied
    reason = first_reason(
        (F.col("dup_of").isNotNull(), "DUPLICATE"),
        (too_long, "CONTEXT_OVERFLOW"),
        (~known, "UNVALIDATED"),
        (~true("v.extract_ok"), "BROKEN_ENV"),
        (passes_empty, F.when(tests, "BUG_IN_TEST_FILE").otherwise("BASELINE_ANOMALY")),
        (unapplied, F.when(tests, "BUG_IN_TEST_FILE").when(missing_file, "BROKEN_BRANCH").otherwise("REFERENCE_PATCH_INVALID")),
        (~true("v.gold.ran"), "BROKEN_ENV"),
        (size_of("v.f2p_effective") == 0, "NO_VALID_F2P"),
    )
    flags = flag_list(
        (F.col("dup_of").isNotNull(), F.concat(F.lit("dup_of:"), F.col("dup_of"))),
        (too_long, f"prompt_gt_{max_prompt_tokens}"),
        (usable & ~true("v.gold.ran"), F.coalesce(F.col("v.gold.err_kind"), F.lit(""))),
        (true("v.gold_needs_ignore_ws"), "GOLD_WHITESPACE_MISMATCH"),
        (tests, "gold_touches_tests"),
        (size_of("v.f2p_dropped") > 0, F.concat(F.lit("F2P_PRUNED:"), size_of("v.f2p_dropped"))),
        (size_of("v.p2p_dropped") > 0, F.concat(F.lit("P2P_PRUNED:"), size_of("v.p2p_dropped"))),
        (F.coalesce(F.col("judge_verdict") == "drop", F.lit(False)), "JUDGE_DROP"),
    )
    return reason, flags


def unit_decision() -> tuple[Column, Column]:
    """(reason, flags) of unit-test tasks. Columns: dup_of and v, the validation record: n_tests, has_reference, gold_ok, empty_ok, empty (struct n_f2p, t_f2p)."""
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    known = F.col("v").isNotNull()
    reference = get("v.has_reference", False)
    passed, of = get("v.empty.n_f2p", 0), get("v.empty.t_f2p", 0)
    half = F.when(of > 0, passed / of).otherwise(0.0) >= 0.5
    untested = get("v.n_tests", 0) == 0
    wrong = reference & ~get("v.gold_ok", False)
    reason = first_reason((F.col("dup_of").isNotNull(), "DUPLICATE"), (~known, "UNVALIDATED"), (untested, "NO_TESTS"), (wrong, "REFERENCE_SOLUTION_FAILS"), (~get("v.empty_ok", True) & half, "BASELINE_ANOMALY"))
    flags = flag_list(
        (F.col("dup_of").isNotNull(), F.concat(F.lit("dup_of:"), F.col("dup_of"))),
        (known & ~untested & ~wrong & ~get("v.empty_ok", True) & ~half, F.concat(F.lit("EMPTY_PASSES_SOME:"), passed, F.lit("/"), of)),
        (known & ~reference, "no_reference_solution"),
    )
    return reason, flags


def band(split: Column, p: Column, std: Column, lo: float = 0.05, hi: float = 0.95, hard_rule: str = "no_signal") -> tuple[Column, Column]:
    """(reason, flag) by the difficulty band, on the train split alone."""
    ours = (split == "train") & p.isNotNull()
    flat = F.coalesce(std, F.lit(1.0)) == 0
    hard = ours & (p < lo) & (F.lit(hard_rule == "p_hat") | flat)
    return F.when(hard, "TOO_HARD").when(ours & (p > hi), "TOO_EASY").otherwise(""), F.when(ours & (p < lo) & ~hard, "HARD_BUT_PARTIAL_SIGNAL")


def hash_order(item: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(item.cast("string"), F.lit(""))))


def hash_split(rows: DataFrame, item: str, n_test: int, n_val: int, seed: int = 0) -> DataFrame:
    """rows with split: the first n_test by hash order are test, the next n_val validation, the rest train. A null item is hashed as an empty text. The two cuts are the ends of two top-k reads, so nothing is sorted as a whole, and the driver holds two hashes."""
    order = hash_order(F.col(item), seed)
    hashes = rows.select(order.alias("h"))

    def cut(n: int) -> str:
        last = hashes.orderBy("h").limit(n).agg(F.max("h")).head()[0] if n else None
        return last or ""

    test, both = cut(n_test), cut(n_test + n_val)
    return rows.withColumn("split", F.when(order <= test, "test").when(order <= both, "validation").otherwise("train"))


def group_split(rows: DataFrame, group: str, n_test: int, n_val: int, seed: int = 0) -> DataFrame:
    """rows with split, a whole group (repository) in one split: groups in hash order, the first n_test test, the next n_val validation."""
    groups = hash_split(rows.select(F.col(group).alias("_tf_group")).distinct(), "_tf_group", n_test, n_val, seed)
    return rows.join(groups, F.col(group).eqNullSafe(F.col("_tf_group")), "left").drop("_tf_group")


def train_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups in neither test nor validation."""
    return rows.select(group).subtract(rows.where(F.col("split").isin("test", "validation")).select(group))


def split_label(status: Column, split: Column) -> Column:
    return F.when(status == "ok", split).otherwise("excluded")


def enriched(rows: DataFrame, values: dict[str, Column], struct: str = "extra_info") -> DataFrame:
    """rows whose struct has further (or other) fields."""
    out = F.col(struct)
    for name, value in values.items():
        out = out.withField(name, value)
    return rows.withColumn(struct, out)


def with_names_line(rows: DataFrame, names: Column, lang: Column, prompt: str = "prompt") -> DataFrame:
    """rows whose last user message says which names the hidden tests need."""
    return rows.withColumn(prompt, scaffold.append_to_last_user(F.col(prompt), text.names_line(names, lang)))


def effective_index(index: DataFrame, validation: DataFrame, key: str = "instance_id") -> DataFrame:
    """index with the effective id lists of the validation records, empty where there are none."""
    none = F.array().cast("array<string>")
    v = validation.select(key, F.col("f2p_effective").alias("_f"), F.col("p2p_effective").alias("_p"))
    return index.drop("f2p_effective", "p2p_effective").join(v, key, "left").withColumn("f2p_effective", F.coalesce("_f", none)).withColumn("p2p_effective", F.coalesce("_p", none)).drop("_f", "_p")


def reason_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where(F.col("reason") != "").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """Rows with each flag, by its part before the colon."""
    return rows.select(F.explode(flags).alias("f")).groupBy(F.substring_index("f", ":", 1).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't among the results yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def registry_records(rows: DataFrame, repos: DataFrame, units: DataFrame, key: str = "instance_id", name: str = "instance") -> DataFrame:
    """rows with the index record of their instance as a struct: the repository index's if it has one, else the unit tests', else null. Fields that one index lacks are null."""
    both = union_all(repos.withColumn("_tf_at", F.lit(0)), units.withColumn("_tf_at", F.lit(1)))
    fields = [c for c in both.columns if c not in (key, "_tf_at")]
    first = both.groupBy(key).agg(F.min_by(F.struct(*fields), F.col("_tf_at")).alias(name))
    return rows.join(first, key, "left")


def registry_lookup(rows: DataFrame, units: DataFrame, repos: DataFrame, key: str = "instance_id", source: str = "data_source", prefixes: tuple[str, str] = ("t15_unittest", "t15_repo_patch")) -> DataFrame:
    """rows with track: by the id's place in an index first, then by the prefix of the data source."""
    u = units.select(key).distinct().withColumn("_tf_u", F.lit(True))
    r = repos.select(key).distinct().withColumn("_tf_r", F.lit(True))
    src = F.coalesce(F.col(source), F.lit(""))
    track = F.when(F.col("_tf_u") | src.startswith(prefixes[0]), "unittest").when(F.col("_tf_r") | src.startswith(prefixes[1]), "swe").otherwise("unknown")
    return rows.join(u, key, "left").join(r, key, "left").withColumn("track", track).drop("_tf_u", "_tf_r")
