"""Registers of units and parties: reference names, aliases, get-or-create, and what follows when a register changes.

A register is a DataFrame with a key; a change gives a new one. Ids of new rows follow the largest one in the order of their keys, so a
batch gives the same ids whatever its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions import units as U
from plinth.operators.keyed import distinct_key, latest_per_key, merge
from plinth.operators.links import best_reference


def unit_key(c: Column) -> Column:
    """What two spellings of a unit have in common."""
    return T.compact(F.trim(c))


def reference_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """(name, name_key): the first spelling of each key; blank names are left out."""
    keyed = names.where(~T.blank(F.col(name))).select(F.col(name).alias("name"), unit_key(F.col(name)).alias("name_key"), F.col(order).alias("__o"))
    return keyed.groupBy("name_key").agg(F.min_by("name", F.struct("__o", "name")).alias("name")).select("name", "name_key")


def numbered(new: DataFrame, old: DataFrame, id_col: str, order: list[str], ranges: int = 64, sampled: int = 4096) -> DataFrame:
    """new with ids after the largest of old, in order. The rows of each range of keys are counted, so no task has to hold all.

    A row's range follows from its own key and fixed bounds: ranges of a shuffle are drawn and merged anew in each of the two scans.
    """
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    drawn = sorted({tuple(r) for r in new.select(*order).na.drop().orderBy(F.xxhash64(*order)).limit(sampled).collect()})
    bounds = drawn[:: -(-len(drawn) // ranges) or 1][1:]
    lit = lambda c, v: F.lit(v).cast(new.schema[c].dataType).alias(c)
    one = len(order) == 1
    key = F.col(order[0]) if one else F.struct(*[F.col(c).alias(c) for c in order])

    def place(low: int, high: int) -> Column:
        """How many of the bounds from low to high the key has reached, and all before."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        held = lit(order[0], bounds[mid][0]) if one else F.struct(*[lit(c, v) for c, v in zip(order, bounds[mid])])
        return F.when(key < held, place(low, mid)).otherwise(place(mid + 1, high))

    spread = new.withColumn("__p", F.when(key.isNull(), 0).otherwise(place(0, len(bounds))))
    counts = spread.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.select("__p", (F.sum("__c").over(W.orderBy("__p")) - F.col("__c")).alias("__before"))  # a row for each range
    own = spread.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return own.join(F.broadcast(before), "__p").withColumn(id_col, F.lit(top) + F.col("__before") + F.col("__n")).drop("__p", "__n", "__before")


def upsert_units(units: DataFrame, names: DataFrame, name: str, order: str) -> DataFrame:
    """units (unit_id, name, name_key) with a row for every key of names; a known key takes the new spelling."""
    found = reference_names(names, name, order)
    known = units.select("unit_id", "name_key").join(found, "name_key").select("unit_id", "name", "name_key")
    new = numbered(found.join(units.select("name_key"), "name_key", "left_anti"), units, "unit_id", ["name_key"])
    rest = units.join(found.select("name_key"), "name_key", "left_anti")
    return rest.select("unit_id", "name", "name_key").unionByName(known).unionByName(new.select("unit_id", "name", "name_key"))


def upsert_aliases(aliases: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """aliases (alias, unit_id, kind) with new ones; an alias points to the unit that named it last."""
    last = latest_per_key(new.select("alias", "unit_id", "kind", order), ["alias"], [order, "unit_id"]).select("alias", "unit_id", "kind")
    return merge(aliases, last, ["alias"])


def seed_reference(units: DataFrame, names: DataFrame, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(units, aliases) of the reference names, each an alias of itself."""
    made = upsert_units(units, names, name, order)
    return made, made.select(F.col("name").alias("alias"), "unit_id", F.lit("reference").alias("kind"))


def resolve_units(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with unit_id: of the best alias that the name equals, begins with or holds; null where the name says more than that
    alias (more segments or a higher rank) or matches none."""
    known = aliases.select("alias", F.col("unit_id").alias("__unit"))
    best = best_reference(rows, known, name, "alias", U.reference_score(F.col(name), F.col("alias")), [-F.col("__unit")])
    says_more = U.preserve_specific(F.col(name), F.col("alias")) & (F.col(name) != F.col("alias"))
    return best.withColumn("unit_id", F.when(~says_more, F.col("__unit"))).select(*rows.columns, "unit_id")


def get_or_create_units(units: DataFrame, aliases: DataFrame, observed: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, aliases, observed with unit_id): names that resolve to no unit, or say more than the one they match, make one.

    The batch resolves against the register as it was; of names with one key the least spelling names the new unit.
    """
    named = observed.where(~T.blank(F.col(name)))
    found = resolve_units(named.select(name).distinct(), name, aliases)
    missing = found.where("unit_id is null").withColumn("__o", F.lit(0))
    after = upsert_units(units, missing, name, "__o")
    created = missing.select(name, unit_key(F.col(name)).alias("name_key")).join(after.select("unit_id", "name_key"), "name_key").select(name, "unit_id")
    every = found.where("unit_id is not null").select(name, "unit_id").unionByName(created)
    seen = every.select(F.col(name).alias("alias"), "unit_id", F.lit("observed").alias("kind"), F.lit(0).alias("__o"))
    fresh = seen.join(aliases.select("alias"), "alias", "left_anti")
    return after, upsert_aliases(aliases, fresh, "__o"), observed.join(every, name, "left")


def refresh_references(rows: DataFrame, name: str, unit: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their unit resolved anew, counts of (rows, changed)); a row that resolves to nothing keeps its unit."""
    new = resolve_units(rows.withColumnRenamed(unit, "__before"), name, aliases)
    both = new.withColumn(unit, F.coalesce("unit_id", "__before"))
    counts = both.agg(F.count("*").alias("rows"), F.count_if(~F.col(unit).eqNullSafe(F.col("__before"))).alias("changed"))
    return both.select(*rows.columns), counts


def unit_contacts(names: DataFrame, name: str, hierarchy: DataFrame) -> DataFrame:
    """(name, top_unit, child_name, tel, fax) of the first line of a hierarchy (top_unit, child_name, tel, fax, ordinal) whose
    child, else whose top unit, the name holds; the longest match first."""
    child = F.col("child_name") != ""
    score = F.when(child & F.col(name).contains(F.col("child_name")), 100 + F.length("child_name")).when(F.col(name).contains(F.col("top_unit")), 10 + F.length("top_unit"))
    lines = hierarchy.withColumn("__alias", F.explode(F.array_distinct(F.array("top_unit", F.when(child, F.col("child_name")).otherwise(F.col("top_unit"))))))
    best = best_reference(names.select(name).distinct(), lines, name, "__alias", score, [-F.col("ordinal")])
    hit = child & F.col(name).contains(F.col("child_name"))
    return best.select(name, F.coalesce("top_unit", F.lit("")).alias("top_unit"), *[F.when(hit, F.col(c)).otherwise("").alias(c) for c in ("child_name", "tel", "fax")])


def upsert_parties(parties: DataFrame, named: DataFrame) -> DataFrame:
    """parties (party_id, party_key, display_name) with a row for every key of named; a known key takes the new name."""
    found = latest_per_key(named.where("party_key <> ''").select("party_key", "display_name"), ["party_key"], ["display_name"])
    known = parties.select("party_id", "party_key").join(found, "party_key").select("party_id", "party_key", "display_name")
    new = numbered(found.join(parties.select("party_key"), "party_key", "left_anti"), parties, "party_id", ["party_key"])
    rest = parties.join(found.select("party_key"), "party_key", "left_anti")
    return rest.select("party_id", "party_key", "display_name").unionByName(known).unionByName(new.select("party_id", "party_key", "display_name"))


def add_distinct_parties(parties: DataFrame, named: DataFrame, order: list[str]) -> DataFrame:
    """parties and a new one for every row of named (party_key, display_name): keys that exist get -2, -3, ..."""
    base = F.regexp_replace("party_key", r"-\d+$", "")
    used = parties.groupBy(base.alias("party_key")).agg(F.count("*").alias("__used"))
    many = distinct_key(named, "party_key", order, "__own").withColumn("__n", F.row_number().over(W.partitionBy("party_key").orderBy(*order)))
    n = F.coalesce("__used", F.lit(0)) + F.col("__n")
    keyed = many.join(used, "party_key", "left").withColumn("party_key", F.when(n == 1, F.col("party_key")).otherwise(F.concat_ws("-", "party_key", n.cast("string"))))
    new = numbered(keyed.select("party_key", "display_name"), parties, "party_id", ["party_key"])
    return parties.select("party_id", "party_key", "display_name").unionByName(new.select("party_id", "party_key", "display_name"))


def creates_party(name: Column, quality: Column, contact: Column, confidence: Column) -> Column:
    """Whether a mention without a matching party makes one: a full name, or more than a surname with a contact or a confidence of 0.9."""
    return (~T.blank(name)) & ((quality == "full_name") | ((quality != "surname_only") & (contact | (confidence >= 0.9))))


def parties_for_mentions(parties: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parties, (mention_id, party_id)) of mentions (mention_id, party_raw, quality, email, phone, confidence) that may make a party."""
    contact = ~T.blank(F.col("email")) | ~T.blank(F.col("phone"))
    good = mentions.where(creates_party(F.col("party_raw"), F.col("quality"), contact, F.col("confidence")))
    keyed = good.select("mention_id", T.party_key(F.col("party_raw")).alias("party_key"), F.trim("party_raw").alias("display_name"))
    after = upsert_parties(parties, keyed)
    return after, keyed.join(after.select("party_id", "party_key"), "party_key").select("mention_id", "party_id")


def parties_for_slots(parties: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parties, slots with a party_id): a slot without a party takes the one of its name's key, made where there is none."""
    open_ = slots.where("party_id is null").withColumn("party_key", T.party_key(F.col("name_norm")))
    after = upsert_parties(parties, open_.select("party_key", F.col("name_norm").alias("display_name")))
    placed = open_.drop("party_id").join(after.select("party_id", "party_key"), "party_key", "left").select(*slots.columns)
    return after, slots.where("party_id is not null").unionByName(placed)
