"""Clusters of topics: numbered digests, coverage, links, aliases."""

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, left

PREVIEW = 120


def topic_index(meetings: DataFrame, municipality: str = "municipality_code", id_col: str = "id") -> DataFrame:
    """Digests of each municipality numbered from 0, meetings by date and id, digests in their order.

    Meetings are dealt and sorted, with their digests as arrays of the columns that are asked for, and digests become rows
    after that: a digest's number is that of the digests of the meetings before, and its place. Rows of one date and id are
    numbered by place first.
    """
    digests = F.col("topic_digests")
    of = lambda value: F.transform(digests, value)
    arrays = {"_topics": of(lambda d: d["topic"]), "_relevances": of(lambda d: d["relevance"]), "_previews": of(lambda d: left(d["digest"], PREVIEW))}
    rows = meetings.filter(F.size(digests) > 0).select(municipality, F.col(id_col).alias("meeting_id"), "held_on", F.size(digests).cast("long").alias("_size"), *[c.alias(k) for k, c in arrays.items()])
    w = Window.partitionBy(municipality).orderBy("held_on", "meeting_id")
    peers = F.collect_list("_size").over(w.rangeBetween(Window.currentRow, Window.currentRow))  # one, where ids are of one meeting each
    told = rows.withColumns({"_peers": peers, "_until": F.sum("_size").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_turn": F.row_number().over(w) - F.rank().over(w)})
    each = told.withColumn("_pos", F.explode(F.sequence(F.lit(0), (F.col("_size") - 1).cast("int"))))
    summed = lambda sizes, value: F.aggregate(sizes, F.lit(0).cast("long"), lambda x, n: x + value(n))
    before = F.col("_until") - summed(F.col("_peers"), lambda n: n - F.least(n, F.col("_pos").cast("long")))
    earlier = summed(F.slice("_peers", 1, F.col("_turn")), lambda n: F.when(n > F.col("_pos"), 1).otherwise(0).cast("long"))
    index = F.when(F.size("_peers") == 1, F.col("_until") - F.col("_size") + F.col("_pos")).otherwise(before + earlier)
    at = lambda name: F.get(F.col(name), F.col("_pos"))
    return each.select(municipality, "meeting_id", "held_on", index.alias("index"), at("_topics").alias("topic"), at("_relevances").alias("relevance"), at("_previews").alias("digest_preview"))


def prompt_line() -> Column:
    return F.concat_ws("\t", F.col("index").cast("string"), "topic", F.regexp_replace("digest_preview", f"{SPACE}+", " "))


def of_many(clusterer: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Marks a clusterer that takes several whole municipalities at once, told apart by a column group that it hands on."""
    clusterer.of_many = True
    return clusterer


#: Digests that a clusterer of many takes at once, or those of one municipality that has more.
MANY = 200_000


def cluster_with(refs: DataFrame, clusterer: Callable[[pd.DataFrame], pd.DataFrame], municipality: str = "municipality_code") -> DataFrame:
    """Clusters that a clusterer makes of each municipality's digests: a row for each member.

    clusterer: takes the columns index, topic and digest_preview of one municipality (the model's prompt; its size bounds a
    call) and returns canonical_name, description, position and member_index. A model's client belongs in it. One marked by
    of_many takes a batch of municipalities in a call, as very many small ones would cost a call each.
    """
    kind = refs.schema[municipality].dataType.simpleString()
    schema = f"{municipality} {kind}, canonical_name string, description string, position long, member_index long"
    names = [c.split()[0] for c in schema.split(", ")]
    many = getattr(clusterer, "of_many", False)

    def run(batches):
        for batch in batches:
            held, digests = batch.column(0), batch.column(1)
            ends = np.cumsum(np.append(0, pc.list_value_length(digests).to_numpy(zero_copy_only=False)))
            flat = pa.Table.from_batches([pa.RecordBatch.from_struct_array(digests.flatten())])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + MANY, "right")) - 1) if many else first + 1
                pdf = flat.slice(ends[first], ends[last] - ends[first]).to_pandas()
                if many:
                    pdf["group"] = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
                out = clusterer(pdf)
                group = pa.array(out["group"] if many else np.full(len(out), first), pa.int64())
                rest = [pa.array(out[c], kind) for c, kind in zip(names[1:], (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([held.take(group), *rest], names=names)
                first = last

    grouped = refs.groupBy(municipality).agg(F.array_sort(F.collect_list(F.struct("index", "topic", "digest_preview"))).alias("digests"))
    return grouped.mapInArrow(run, schema)


@of_many
def normalising_clusterer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The clusterer that needs no model: topics equal in their last word are one cluster, named by that word."""
    topics, which = np.unique(pdf["topic"].to_numpy(dtype=object), return_inverse=True)
    last = np.array([re.split(r"\s+", s.strip())[-1] for s in topics.tolist()], dtype=object)
    words, word = np.unique(last, return_inverse=True)
    word = word[which] if len(words) else np.zeros(0, np.int64)
    group = pdf["group"].to_numpy() if "group" in pdf else np.zeros(len(pdf), np.int64)
    # a word's place among those of its municipality
    pairs, pair = np.unique(group * (len(words) + 1) + word, return_inverse=True)
    of = pairs // (len(words) + 1)
    place = np.arange(len(pairs)) - np.searchsorted(of, of)
    return pd.DataFrame({"canonical_name": words[word], "description": "", "position": place[pair].astype("int64"), "member_index": pdf["index"].to_numpy(), "group": group})


def missing(refs: DataFrame, members: DataFrame, municipality: str = "municipality_code") -> DataFrame:
    """Digests that no cluster has."""
    m = members.select(F.col(municipality).alias("_m"), F.col("member_index").alias("_i")).distinct()
    return refs.join(m, (F.col(municipality) == F.col("_m")) & (F.col("index") == F.col("_i")), "left_anti")


def assigned_twice(members: DataFrame, municipality: str = "municipality_code") -> DataFrame:
    return members.groupBy(municipality, F.col("member_index").alias("index")).agg(F.count("*").alias("n")).filter("n > 1")


def cluster_rows(refs: DataFrame, members: DataFrame, municipality: str = "municipality_code") -> tuple[DataFrame, DataFrame]:
    """Topics (aliases are the member topics other than the canonical name, first seen first) and links of meetings to topics.

    Members out of range are dropped. A meeting links to a topic once, with its first digest; a digest in two clusters gives
    two links; the link holds the preview.
    """
    r = refs.select(F.col(municipality).alias("_m"), "index", "meeting_id", "topic", "relevance", "digest_preview")
    joined = members.join(r, (F.col(municipality) == F.col("_m")) & (F.col("member_index") == F.col("index"))).drop("_m")
    key = [municipality, "canonical_name"]
    names = joined.groupBy(*key, "topic").agg(F.min("index").alias("first"))
    aliases = names.groupBy(*key).agg(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("first", "topic"))), lambda x: x["topic"]), lambda t: t != F.col("canonical_name")).alias("aliases"))
    described = joined.groupBy(*key).agg(F.max_by("description", "position").alias("description"))
    topics = aliases.join(described, key)
    first = joined.groupBy(*key, "meeting_id").agg(F.min_by(F.struct("relevance", "digest_preview"), F.struct("position", "index")).alias("f"))
    links = first.select("meeting_id", *key, F.col("f.relevance").alias("relevance"), F.col("f.digest_preview").alias("digest"))
    return topics, links


def token_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by model: prices are per million tokens; the price table is a few rows."""
    joined = calls.join(F.broadcast(prices), "model")
    cost = F.sum(F.col("input_tokens") / 1e6 * F.col("price_in") + F.col("output_tokens") / 1e6 * F.col("price_out"))
    return joined.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), cost.alias("cost"))
