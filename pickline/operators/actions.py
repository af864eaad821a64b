"""From decisions to a reviewable plan of reversible actions, and back from outcomes to stamps.

A plan has one row per action: ``stage`` and ``sort_key`` order it (single assets by id, then
stacks, enrichment, album), ``ops`` lists its operations. An album holds any number of items, so
it is one action row per item, all with the album's name, instead of one row with all ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.functions.scalars import detail_text, strip
from pickline.operators.groups import group_members
from pickline.operators.worklists import decision_filter, unenriched
from pickline.schemas import Options
from pickline.session import cut

OP_TYPE = (
    "struct<op:string, asset_id:string, rating:int, visibility:string, is_favorite:boolean, "
    "description:string, tag:string, name:string, asset_ids:array<string>>"
)
FIELDS = ("rating", "visibility", "is_favorite", "description")

# Tag per decision and category below the tag root, and group per bucket.
TAGS = {"reject": "reject", "five_star": "best", "burst_loser": "burst-loser"}
CATEGORY_TAGS = {
    "screenshot": "screenshot", "document": "document", "meme": "meme", "other": "other",
}
FALLBACK_TAG = "nonphoto"
GROUPS = {
    "reject": "reject", "nonphoto": "nonphoto", "five_star": "stars", "four_star": "stars",
    "three_star": "stars", "two_star": "stars", "one_star": "stars", "album": "stars",
    "burst_loser": "stacks", "burst_stack": "stacks", "enrich": "enrich",
}
PLAN_COLUMNS = ("stage", "sort_key", "group", "bucket", "asset_id", "burst_id", "description", "ops")
_STAGES = {"asset": 0, "burst_stack": 1, "enrich": 2, "album": 3}


def _op(op: str, **fields: Column) -> Column:
    names = ("asset_id", *FIELDS, "tag", "name", "asset_ids")
    parts = [F.lit(op).alias("op")]
    parts += [fields.get(n, F.lit(None)).alias(n) for n in names]
    return F.struct(*parts).cast(OP_TYPE)


def _update(**fields: Column) -> Column:
    return _op("update_asset", asset_id=F.col("asset_id"), **fields)


def _tag(tag: Column) -> Column:
    return _op("tag", asset_id=F.col("asset_id"), tag=tag)


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def _planned(df: DataFrame, stage: str) -> DataFrame:
    return df.select(
        F.lit(_STAGES[stage]).alias("stage"), "sort_key",
        _lookup(F.col("bucket"), GROUPS, F.col("bucket")).alias("group"), "bucket",
        F.col("asset_id").cast("string").alias("asset_id"),
        F.col("burst_id").cast("string").alias("burst_id"), "description", "ops",
    )


def asset_actions(
    decisions: DataFrame, favorite_five: bool = True, tag_root: str = Options.tag_root
) -> DataFrame:
    """One action per decision: reject, archive, tag or rate; ``middle`` gives none."""
    bucket, asset = F.col("bucket"), F.col("asset_id")
    category = F.coalesce(detail_text(F.col("detail"), "$.category"), F.lit(""))
    tags = {name: f"{tag_root}/{tag}" for name, tag in TAGS.items()}
    kind_tag = _lookup(
        category, {c: f"{tag_root}/{t}" for c, t in CATEGORY_TAGS.items()},
        F.lit(f"{tag_root}/{FALLBACK_TAG}"),
    )
    five = {"rating": F.lit(5)}
    if favorite_five:
        five["is_favorite"] = F.lit(True)
    archive = F.lit("archive")
    ops = (
        F.when(bucket == "reject", F.array(
            _update(rating=F.lit(-1), visibility=archive), _tag(F.lit(tags["reject"]))))
        .when(bucket == "nonphoto", F.array(_update(visibility=archive), _tag(kind_tag)))
        .when(bucket == "burst_loser", F.array(_tag(F.lit(tags["burst_loser"]))))
        .when(bucket == "five_star", F.array(_update(**five), _tag(F.lit(tags["five_star"]))))
    )
    extras = ", made a favorite" if favorite_five else ""
    text = (
        F.when(bucket == "reject",
               F.format_string("%s rejected: archived, rated -1, tagged %s", asset,
                               F.lit(tags["reject"])))
        .when(bucket == "nonphoto",
              F.format_string("%s is no photograph but %s: archived, tagged %s", asset,
                              F.when(category != "", category).otherwise("unknown"), kind_tag))
        .when(bucket == "burst_loser",
              F.format_string("%s lost in its group: tagged %s", asset, F.lit(tags["burst_loser"])))
        .when(bucket == "five_star",
              F.format_string(f"%s among the best: rated 5{extras}, tagged %s", asset,
                              F.lit(tags["five_star"])))
    )
    for stars, name in ((4, "four_star"), (3, "three_star"), (2, "two_star"), (1, "one_star")):
        ops = ops.when(bucket == name, F.array(_update(rating=F.lit(stars))))
        text = text.when(bucket == name, F.format_string(f"%s rated {stars}", asset))
    burst = detail_text(F.col("detail"), "$.burst_id")
    rows = decisions.select(
        "asset_id", "bucket", F.col("asset_id").alias("sort_key"),
        F.when((bucket == "burst_loser") & (burst != ""), burst).alias("burst_id"),
        text.alias("description"), ops.alias("ops"),
    )
    return _planned(rows.filter(F.col("ops").isNotNull()), "asset")


def stack_actions(bursts: DataFrame, assets: DataFrame, unapplied_only: bool = True) -> DataFrame:
    """One stack per judged live group: the winner, then its losers that are still members."""
    todo = bursts.filter(F.col("applied_at").isNull()) if unapplied_only else bursts
    rows = todo.select("burst_id", "winner_id", "reject_ids").join(
        group_members(assets), "burst_id"
    ).withColumn(
        "losers", F.filter("reject_ids", lambda r: F.array_contains("member_ids", r))
    ).filter(F.array_contains("member_ids", F.col("winner_id")) & (F.size("losers") > 0))
    members = F.concat(F.array("winner_id"), "losers")
    return _planned(rows.select(
        F.lit("burst_stack").alias("bucket"), F.lit(None).alias("asset_id"), "burst_id",
        F.col("burst_id").alias("sort_key"),
        F.format_string("%d frames stacked below %s", F.size(members), F.col("winner_id"))
        .alias("description"),
        F.array(_op("stack", asset_ids=members)).alias("ops"),
    ), "burst_stack")


def enrich_actions(
    triage: DataFrame,
    assets: DataFrame,
    captions: bool = True,
    keywords: bool = False,
    prefix: str = "kw",
) -> DataFrame:
    """Captions for assets without a description, and keyword tags; none when both are off."""
    rows = unenriched(triage, assets)
    blank = strip(F.coalesce("description", F.lit(""))) == ""
    caption = strip(F.coalesce("caption", F.lit("")))
    write = F.lit(captions) & blank & (caption != "")
    none = F.array().cast("array<string>")
    names = F.coalesce("keywords", none) if keywords else none
    if prefix:
        names = F.transform(names, lambda k: F.concat(F.lit(f"{prefix}/"), k))
    update = F.when(write, F.array(_update(description=caption))).otherwise(
        F.array().cast(f"array<{OP_TYPE}>")
    )
    rows = rows.select(
        "asset_id", F.lit("enrich").alias("bucket"), F.col("asset_id").alias("sort_key"),
        F.lit(None).alias("burst_id"),
        F.concat_ws(
            "", F.lit("enrich "), F.col("asset_id"), F.lit(": "),
            F.concat_ws(
                "; ", F.when(write, F.concat(F.lit("caption '"), caption, F.lit("'"))),
                F.when(F.size(names) > 0, F.concat(F.lit("tags "), F.array_join(names, ", "))),
            ),
        ).alias("description"),
        F.concat(update, F.transform(names, _tag)).alias("ops"),
    )
    return _planned(rows.filter(F.size("ops") > 0), "enrich")


def album_action(decisions: DataFrame, album: str, min_stars: int = 5) -> DataFrame:
    """One row per starred item for the album, whether or not its decision was applied."""
    wanted = ["five_star"] if min_stars >= 5 else ["five_star", "four_star"]
    return _planned(decisions.filter(F.col("bucket").isin(wanted)).select(
        F.lit("album").alias("bucket"), F.lit(None).alias("burst_id"),
        F.lit(None).alias("none"), F.col("asset_id").alias("sort_key"),
        F.concat(F.lit(f"ensure album '{album}' holds "), F.col("asset_id")).alias("description"),
        F.array(_op("album", asset_id=F.col("asset_id"), name=F.lit(album))).alias("ops"),
    ).withColumnRenamed("none", "asset_id"), "album")


def plan(
    tables: dict[str, DataFrame], options: Options | None = None, unapplied_only: bool = True
) -> DataFrame:
    """All actions the tables call for; order by ``stage, sort_key`` to get execution order."""
    o = options or Options()
    todo = decision_filter(tables["decisions"], unapplied_only=unapplied_only)
    parts = [
        asset_actions(todo, o.favorite_five, o.tag_root),
        stack_actions(tables["bursts"], tables["assets"], unapplied_only),
    ]
    if o.write_captions or o.keyword_tags:
        parts.append(enrich_actions(tables["triage"], tables["assets"], o.write_captions,
                                    o.keyword_tags, o.keyword_prefix))
    if o.album:
        parts.append(album_action(tables["decisions"], o.album, o.album_min_stars))
    return reduce(DataFrame.unionByName, parts)


def select_groups(plan: DataFrame, groups: str | set[str] | None = None) -> DataFrame:
    """Actions of the named groups; an unknown or empty list is an error, ``None`` means all."""
    if groups is None:
        return plan
    names = set(groups.split(",")) if isinstance(groups, str) else {str(g) for g in groups}
    names = {n.strip().lower() for n in names} - {""}
    unknown = names - set(GROUPS.values())
    if unknown or not names:
        raise ValueError(f"unknown or no action groups: {sorted(unknown)}")
    return plan.filter(F.col("group").isin(*sorted(names)))


def exploded_ops(plan: DataFrame) -> DataFrame:
    """One row per operation, numbered within its action."""
    return plan.select(
        *[c for c in plan.columns if c != "ops"], F.posexplode("ops").alias("op_no", "o")
    ).select(*[c for c in plan.columns if c not in ("ops", "asset_id", "description")],
             "op_no", F.col("asset_id").alias("action_asset"), "o.*")


def fold_tags(plan: DataFrame) -> DataFrame:
    """Distinct ``(tag, asset_id)``, one row per attachment, however many assets a tag has."""
    return exploded_ops(plan).filter("op = 'tag'").select("tag", "asset_id").distinct()


def fold_updates(plan: DataFrame) -> DataFrame:
    """One write per asset, each field from the last operation in plan order that sets it."""
    order = F.struct("stage", "sort_key", "op_no")
    ops = exploded_ops(plan).filter("op = 'update_asset'").withColumn("at", order)
    return ops.groupBy("asset_id").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in FIELDS
    ])


def reconcile(plan: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """What to stamp, from the outcome of every operation.

    ``outcomes`` is ``(stage, sort_key, op_no, ok)``; a missing outcome counts as failed. Returns
    ``assets (asset_id, ok)`` over all operations of an asset, ``decisions`` and ``enriched``
    (ids to stamp: only those whose own action was selected and whose asset had no failure),
    ``stacks`` (group ids to stamp) and one row of ``counters``.
    """
    # read by every output below: written once
    ops = cut(exploded_ops(plan).join(
        outcomes, ["stage", "sort_key", "op_no"], "left"
    ).select(
        "bucket", "burst_id", "action_asset", "op_no", "op", "asset_id", "tag",
        F.coalesce("ok", F.lit(False)).alias("ok"),
    ))
    assets = ops.filter(F.col("action_asset").isNotNull()).groupBy(
        F.col("action_asset").alias("asset_id")
    ).agg(
        F.bool_and("ok").alias("ok"),
        F.bool_or(F.col("bucket") == "enrich").alias("has_enrich"),
        F.bool_or(F.col("bucket") != "enrich").alias("has_decision"),
    )
    done = assets.filter("ok")
    op, ok, bucket = F.col("op"), F.col("ok"), F.col("bucket")
    writes = ops.filter(op.isin("tag", "update_asset")).groupBy("op", "tag", "asset_id").agg(
        F.bool_and("ok").alias("ok")
    )

    def counts(df: DataFrame, **named: Column) -> DataFrame:
        row = df.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
        return row.unpivot([], list(named), "counter", "value")

    counters = counts(
        ops,
        selected=(F.col("op_no") == 0) & (bucket != "album"),
        stacks_created=(op == "stack") & ok,
        stacks_failed=(op == "stack") & ~ok,
        album_assets=(op == "album") & ok,
    ).unionByName(counts(
        assets, assets_done=ok, assets_failed=~ok, enriched=ok & F.col("has_enrich"),
    )).unionByName(counts(
        writes, assets_updated=(op == "update_asset") & ok, assets_tagged=(op == "tag") & ok,
    ))
    stacks = ops.filter("op = 'stack'")
    return {
        "assets": assets.select("asset_id", "ok"),
        "decisions": done.filter("has_decision").select("asset_id"),
        "enriched": done.filter("has_enrich").select("asset_id"),
        "stacks": stacks.filter("ok").select("burst_id"),
        "counters": counters,
    }
