"""Record linkage: blocking, scores, ranks, confidence, enrichment, overwriting by an authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratings, text


def subjects(tests: DataFrame, participants: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Distinct subject vehicles of tests; a null vehicle number never matches."""
    p = participants.where("kind = 'subject_vehicle'").select("test_no", "vehicle_no")
    return tests.select("test_no").join(p, "test_no").join(vehicles, ["test_no", "vehicle_no"]).select("test_no", "vehicle_no", "make", "model", "model_year").distinct()


def key_ready(year: Column, make: Column, model: Column, least: int = 2011) -> Column:
    """ready, or why a subject cannot be looked up."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(year.isNull() | (year < least), "year_missing_or_old").when(blank(make), "make_missing").when(blank(model), "model_missing").otherwise("ready")


def candidates(left: DataFrame, right: DataFrame, block: list[str], score: Column, least: int, key: list[str], order: list, most: int, reach: list[tuple[Column, Column]] | None = None) -> DataFrame:
    """Pairs within a block whose score reaches `least`; of each subject the best `most`, ranked.

    reach: what pairs must share to reach `least`, in one way or another: (array of values of the left row, value of the right row) for each way.
    Pairs that share nothing are then never made, so a large block costs what its values have in common and not its square; null shares nothing.
    Without it, all pairs of a block are scored."""
    if reach:
        ways = range(len(reach))
        of = lambda i: lambda v: F.struct(F.lit(i).alias("_way"), v.cast("string").alias("_value"))
        a = left.select("*", *[F.array_distinct(x.cast("array<string>")).alias(f"_l{i}") for i, (x, _) in enumerate(reach)])
        cells = [F.coalesce(F.transform(f"_l{i}", of(i)), F.array().cast("array<struct<_way:int,_value:string>>")) for i in ways]
        a = a.select("*", F.inline(F.concat(*cells)))
        b = right.select("*", *[y.cast("string").alias(f"_r{i}") for i, (_, y) in enumerate(reach)])
        b = b.select("*", F.inline(F.array(*[of(i)(F.col(f"_r{i}")) for i in ways])))
        # a pair that meets in several ways counts in the first of them
        shared = [F.coalesce(F.array_contains(f"_l{i}", F.col(f"_r{i}")), F.lit(False)) for i in ways]
        first = F.lit(0)
        for i in reversed(ways):
            first = F.when(shared[i], i).otherwise(first)
        made = a.join(b, [*block, "_way", "_value"]).where(F.col("_way") == first)
        pairs = made.drop("_way", "_value", *[f"_{side}{i}" for side in "lr" for i in ways])
    else:
        pairs = left.join(right, block)
    pairs = pairs.withColumn("score", score).where(F.col("score") >= least)
    w = Window.partitionBy(*key).orderBy(F.desc("score"), *order)
    return pairs.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= most)


def best_candidates(left: DataFrame, right: DataFrame, block: list[str], ways: list[tuple[Column, Column, int]], least: int, key: list[str], order: list[str], most: int, alike: list[str], apart: tuple[str, str]) -> DataFrame:
    """The same rows as `candidates`, without making the pairs, where a score says in which ways two rows meet: it is the most that any of them gives.

    ways: (an array of values of the left row, each an array of texts; the value of the right row, an array of texts; points).  A value with a null in it meets nothing.
    alike: the columns of the left rows that the values are made of.  apart: a left and a right column that a pair must not have equal; the right one is one of
    `order` (columns of the right rows, ascending), and nothing else forbids a pair.

    Of the right rows that share a value only the first `most` (and the row's own) by order can be among the best, for what stands before them has at least as many points; and
    left rows of a block that are alike see the same lists.  So a block costs its rows once, and its distinct values times what they may meet, never the square of its rows."""
    ways = [w for w in ways if w[2] >= least]
    whole = lambda v: ~F.exists(v, lambda x: x.isNull())
    cell = lambda i, n: lambda v: F.struct(F.lit(i).alias("_way"), v.alias("_value"), F.lit(n).alias("_points"))
    # equal right rows stand for one; they are counted, and each is a pair in the end
    rows = right.where(F.col(apart[1]).isNotNull()).groupBy(*right.columns).agg(F.count(F.lit(1)).alias("_times"))
    payload = [*order, *[c for c in rows.columns if c not in (*block, *order)]]
    places = [F.col(f"_row.{c}") for c in order]
    met = rows.select(*block, F.struct(*payload).alias("_row"), F.inline(F.filter(F.array(*[cell(i, n)(v) for i, (_, v, n) in enumerate(ways)]), lambda x: whole(x["_value"])))).drop("_points")
    early = F.dense_rank().over(Window.partitionBy(*block, "_way", "_value").orderBy(*places))
    lists = met.withColumn("_n", early).where(F.col("_n") <= most + 1).groupBy(*block, "_way", "_value").agg(F.collect_list("_row").alias("_rows"))
    asked = F.flatten(F.array(*[F.transform(F.filter(F.array_distinct(v), whole), cell(i, n)) for i, (v, _, n) in enumerate(ways)]))
    kinds = left.select(*block, *alike).distinct().select(*block, *alike, F.inline(asked))
    # all sides grow with the data, and what is small as files is not so as a table on the driver
    looked = kinds.join(lists.hint("merge"), [*block, "_way", "_value"]).select(*block, *alike, "_points", F.explode("_rows").alias("_row")).repartition(*block, *alike)
    pairs = looked.groupBy(*block, *alike, "_row").agg(F.max("_points").alias("score"))
    # of the row's own rows there is at most one a number of points
    spare = len({n for *_, n in ways})
    first = F.dense_rank().over(Window.partitionBy(*block, *alike).orderBy(F.desc("score"), *places))
    best = pairs.withColumn("_n", first).where(F.col("_n") <= most + spare).groupBy(*block, *alike).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "_row"))).alias("_best"))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in block] + [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in alike]
    own = left.where(F.col(apart[0]).isNotNull()).alias("l").join(best.hint("merge").alias("r"), same).select("l.*", "_best")
    others = F.slice(F.filter("_best", lambda x: x["_row"][apart[1]] != F.col(apart[0])), 1, most)
    each = own.select(*left.columns, F.explode(others).alias("_x")).select(*left.columns, *[F.col(f"_x._row.{c}") for c in payload], (-F.col("_x._s")).alias("score"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.least("_times", F.lit(most)).cast("int"))).alias("_turn")).drop("_times", "_turn")
    w = Window.partitionBy(*key).orderBy(F.desc("score"), *order)
    return each.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= most)


def score_counts(left: DataFrame, right: DataFrame, block: list[str], same: tuple[str, str, int], near: tuple[str, str, list[tuple[int, int]]], least: int, apart: tuple[str, str]) -> DataFrame:
    """How many candidates each left key has at each score: all that reach `least`, however many, without making the pairs.

    same: a left and a right column, and the points where they are equal.  near: a left and a right column of whole numbers, and steps (reach, points), small reaches first:
    numbers at most `reach` apart give the points of the first step that holds.  A score is the sum of both; null gives nothing.
    apart: a left and a right column (the keys) that a pair must not have equal; such pairs are counted in the same way and taken off.
    Pairs are numbered by sums and differences of counts of right rows, so a block costs its rows, never their square.
    One row for each left key with candidates; _scores: (score, candidates), highest first."""
    (an, bn, whole), (asz, bsz, steps), (mine, theirs) = same, near, apart
    side = lambda df, *c: df.select(F.col(c[0]).alias("_key"), *block, F.col(c[1]).alias("_same"), F.col(c[2]).cast("long").alias("_near")).where(F.col("_key").isNotNull())
    a, b = side(left, mine, an, asz), side(right, theirs, bn, bsz)
    far, ways = steps[-1][0], range(len(steps))

    def counted(rows: DataFrame, met: DataFrame, on: list[str]) -> tuple[DataFrame, dict[int, Column]]:
        """Rows with what counts the rows of `met` equal in `on`, and for each score how many these are."""
        around = met.where("_near is not null").select(*on, "_same", "_near", F.explode(F.sequence(F.lit(-far), F.lit(far))).alias("_by")).withColumn("_near", F.col("_near") + F.col("_by"))
        both = around.groupBy(*on, "_same", "_near").agg(*[F.count_if(F.abs("_by") <= r).alias(f"_b{i}") for i, (r, _) in enumerate(steps)])
        sized = both.groupBy(*on, "_near").agg(*[F.sum(f"_b{i}").alias(f"_s{i}") for i in ways])
        named = met.groupBy(*on, "_same").agg(F.count(F.lit(1)).alias("_m"))
        # all sides grow with the data, and what is small as files is not so as a table on the driver
        out = rows
        for counts, to in ((both, [*on, "_same", "_near"]), (sized, [*on, "_near"]), (named, [*on, "_same"])):
            out = out.join(counts.hint("merge"), to, "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        step = lambda c, i: n(f"{c}{i}") - n(f"{c}{i - 1}") if i else n(f"{c}0")
        found = [(whole, n("_m") - n(f"_b{ways[-1]}"))]
        for i, (_, points) in enumerate(steps):
            found += [(whole + points, step("_b", i)), (points, step("_s", i) - step("_b", i))]
        # scores that come out equal count together
        return out, {s: sum((c for p, c in found if p == s), F.lit(0)) for s in sorted({p for p, _ in found if p >= least}, reverse=True)}

    # left rows that are alike meet the same rows of a block
    kinds, per = counted(a.select(*block, "_same", "_near").distinct(), b, block)
    kinds = kinds.select(*block, "_same", "_near", *[c.alias(f"_n{s}") for s, c in per.items()])
    # the right rows of a key are mostly alike, and taken off as one; only those of the other keys are counted by key
    held = b.groupBy(*block, "_key").agg(F.count(F.lit(1)).alias("_own"), F.min(F.struct("_same", "_near")).alias("_lo"), F.max(F.struct("_same", "_near")).alias("_hi"))
    one = F.col("_lo").eqNullSafe(F.col("_hi"))
    gap, points = F.abs(F.col("l._near") - F.col("_lo._near")), F.lit(0)
    for r, n in reversed(steps):
        points = F.when(gap <= r, n).otherwise(points)
    points += F.when(F.col("l._same") == F.col("_lo._same"), whole).otherwise(0)
    alike = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in block] + [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_same", "_near")]
    met = a.join(held.hint("merge"), [*block, "_key"], "left").alias("l").join(kinds.hint("merge").alias("r"), alike)
    met = met.select("_key", *[(F.col(f"_n{s}") - F.coalesce(F.when(one & (points == s), F.col("_own")), F.lit(0))).alias(f"_n{s}") for s in per])
    mixed = held.where(~one).select(*block, "_key").hint("merge")
    own, less = counted(a.join(mixed, [*block, "_key"], "left_semi"), b.join(mixed, [*block, "_key"], "left_semi"), [*block, "_key"])
    each = met.unionByName(own.select("_key", *[(-c).alias(f"_n{s}") for s, c in less.items()])).groupBy("_key").agg(*[F.sum(f"_n{s}").alias(f"_n{s}") for s in per])
    scores = F.filter(F.array(*[F.struct(F.lit(s).alias("score"), F.col(f"_n{s}").alias("candidates")) for s in per]), lambda x: x["candidates"] > 0)
    return each.select(F.col("_key").alias(mine), scores.alias("_scores")).where(F.size("_scores") > 0)


def rank(df: DataFrame, key: str, score: str, order: list) -> DataFrame:
    return df.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *order)))


def confidence(df: DataFrame, key: str, score: str = "score", rank_: str = "candidate_rank") -> DataFrame:
    """Per subject: candidates, best and second score, and how sure the first one is."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("candidate_count"), F.max(F.when(F.col(rank_) == 1, F.col(score))).alias("top_score"), F.max(F.when(F.col(rank_) == 2, F.col(score))).alias("second_score"))
    return by.withColumn("confidence", confidence_of(F.col("candidate_count"), F.col("top_score"), F.col("second_score")))


def confidence_of_counts(df: DataFrame, key: str) -> DataFrame:
    """The same for all candidates of a subject, by `score_counts`."""
    first, second = F.get("_scores", F.lit(0)), F.get("_scores", F.lit(1))
    by = df.select(
        key, F.aggregate("_scores", F.lit(0).cast("long"), lambda n, x: n + x["candidates"]).alias("candidate_count"),
        first["score"].alias("top_score"), F.when(first["candidates"] > 1, first["score"]).otherwise(second["score"]).alias("second_score"),
    )
    return by.withColumn("confidence", confidence_of(F.col("candidate_count"), F.col("top_score"), F.col("second_score")))


def confidence_of(n: Column, top: Column, second: Column) -> Column:
    gap = F.when(second.isNull(), top + 999).otherwise(top - second)
    return (
        F.when(n == 0, "UNMATCHED").when(n == 1, "HIGH_SINGLE_VARIANT")
        .when(((top >= 25) & (gap >= 10)) | ((top >= 12) & (gap >= 5)), "HIGH_DISAMBIGUATED")
        .when((top > 0) & (gap >= 1), "MEDIUM_RANKED").otherwise("REVIEW_AMBIGUOUS_VARIANT")
    )


SELECTION = {"UNMATCHED": "none", "HIGH_SINGLE_VARIANT": "auto", "HIGH_DISAMBIGUATED": "auto", "HIGH_EQUIVALENT_RATING": "auto", "HIGH_TOP_EQUIVALENT_RATING": "auto", "HIGH_REPORT_DISAMBIGUATED": "auto", "MEDIUM_RANKED": "review", "REVIEW_AMBIGUOUS_VARIANT": "review"}


def selection_status(confidence_: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SELECTION.items() for x in kv])[confidence_]


def equivalence(df: DataFrame, key: str, signature: str, score: str, base: DataFrame) -> DataFrame:
    """Raises a doubtful confidence when all candidates, or all of those tied at the top, have one signature."""
    top = F.col(score) == F.max(score).over(Window.partitionBy(key))
    tie = lambda c: F.when(F.col("_tie"), c)
    tops = df.withColumn("_tie", F.coalesce(top, F.lit(False))).groupBy(key).agg(
        F.min(signature).alias("_lo"), F.max(signature).alias("_hi"), F.count_if(F.col(signature).isNull()).alias("_none"), F.count(F.lit(1)).alias("_n"),
        F.min(tie(F.col(signature))).alias("_tlo"), F.max(tie(F.col(signature))).alias("_thi"), F.count_if("_tie").alias("_tn"),
    )
    doubt = F.col("confidence").isin("MEDIUM_RANKED", "REVIEW_AMBIGUOUS_VARIANT") & (F.col("_none") == 0)
    out = base.join(tops.where("_tn > 0"), key)
    raised = F.when(doubt & (F.col("_lo") == F.col("_hi")), "HIGH_EQUIVALENT_RATING").when(doubt & (F.col("_tn") > 1) & (F.col("_tn") < F.col("_n")) & (F.col("_tlo") == F.col("_thi")), "HIGH_TOP_EQUIVALENT_RATING").otherwise(F.col("confidence"))
    return out.withColumn("confidence", raised).drop("_lo", "_hi", "_none", "_n", "_tlo", "_thi", "_tn")


def evidence_rerank(df: DataFrame, key: str, evident: Column, bonus: int = 100) -> DataFrame:
    """Ranks anew after a bonus for evidence; old rank breaks ties."""
    return df.withColumn("score", F.col("score") + F.when(evident, bonus).otherwise(0)).withColumn("candidate_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "candidate_rank")))


def unique_evidence(reports: DataFrame, candidates_: DataFrame, key: str, id_: str) -> DataFrame:
    """Reports whose id fits exactly one candidate of the subject."""
    hit = candidates_.join(reports.select(key, F.col(id_).alias("_id")), key).where(F.col(id_) == F.col("_id"))
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(id_).alias(id_)).where("_n = 1").drop("_n")


def enrich(df: DataFrame, csv: DataFrame, on: list[str], fallback: list[str], columns: list[str]) -> DataFrame:
    """Columns of an external table by normal forms of `on`; where that finds no row, by `fallback` (names of df; same places in csv).

    Of rows of the table with equal keys the least by `columns` counts (nulls first); a row that is found counts even if its columns are null."""
    norm = lambda d, names: [text.alnum(F.col(c).cast("string")).alias(f"_k{i}") for i, c in enumerate(names)]
    keys = [f"_k{i}" for i in range(len(on))]
    one = csv.select(*norm(csv, on), F.struct(*columns).alias("_row")).groupBy(*keys).agg(F.min("_row").alias("_x"))
    a = df.select("*", *norm(df, on)).join(one, keys, "left").drop(*keys)
    b = a.select("*", *norm(a, fallback)).join(one.withColumnRenamed("_x", "_y"), keys, "left").drop(*keys)
    found = F.coalesce("_x", "_y")  # a struct is null only where there was no row
    return b.select(*[F.col(c) for c in df.columns], *[found[c].alias(c) for c in columns])


def best_variant(df: DataFrame, key: str, score: str, order: list) -> DataFrame:
    """One row a key: the highest score, ties by order."""
    return rank(df, key, score, order).where("candidate_rank = 1").drop("candidate_rank")


def adoption_status(matched: Column, conflict: Column, differs: Column) -> Column:
    return F.when(~matched, "NO_CSV_MATCH").when(conflict, "REVIEW_CONFLICT").when(differs, "READY_OFFICIAL_ENRICHMENT").otherwise("ALREADY_ALIGNED")


def overwrite(df: DataFrame, authority: DataFrame, on: str, fields: dict[str, str]) -> DataFrame:
    """Columns take the authority's value where it is allowed to say something; fields: column -> kind of value."""
    a = authority.select(on, *[F.col(c).alias(f"_a_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = df.join(a, on, "left")
    cols = []
    for c in df.columns:
        if c in fields:
            apply, value = ratings.authoritative(fields[c], F.col(f"_a_{c}"))
            cols.append(F.when(F.coalesce("_hit", F.lit(False)) & apply, value).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def overlay_upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """New rows replace old ones of the same key; of repeated new rows the last by order counts."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def overlay_metrics(df: DataFrame, subject: str) -> DataFrame:
    """One row: candidates, subjects, subjects with an automatic first choice, and for review."""
    first = F.col("candidate_rank") == 1
    chosen = lambda status: F.coalesce(F.bool_or(first & (F.col("selection_status") == status)), F.lit(False))
    # by subject first: counts of distinct subjects over all rows at once would pass each row on three times
    by = df.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"), chosen("auto").alias("_auto"), chosen("review").alias("_review"))
    named = F.col(subject).isNotNull()
    return by.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("candidate_count"),
        F.count_if(named).alias("subject_count"),
        F.count_if(named & F.col("_auto")).alias("auto_subjects"),
        F.count_if(named & F.col("_review")).alias("review_subjects"),
    )
