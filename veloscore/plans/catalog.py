"""Registered queries over the driver's tables, each with its DuckDB oracle SQL.

Every query reads the given Parquet tables (or files Spark writes from them) in full. Raw
predictions are compared as ``round(x, 8)``; integers use ``try_cast(round(x, 6) as int)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscore.functions.columns import to_int
from veloscore.functions.sequence_sql import sequence_sql
from veloscore.functions.sql import network_sql
from veloscore.operators.attaching import attach, score_attached
from veloscore.operators.features import split_features, tag_key
from veloscore.operators.indexing import row_index
from veloscore.operators.labels import encode_labels, label_dictionary
from veloscore.operators.normalise import feature_statistics, fit_normaliser
from veloscore.operators.relational import score_relational
from veloscore.operators.reporting import ROW_LINE, TIME_LINE, report
from veloscore.operators.scoring import score
from veloscore.operators.sequence import score_sequence
from veloscore.plans.jobs import score_and_report, scored, timed_runs, timed_stage
from veloscore.plans.sinks import scored_count, write_predictions
from veloscore.session import scratch_path
from veloscore.sources.model_table import (demo_class_model, demo_multi_model, demo_scalar_model,
                                           demo_vector_model, load_model, publish_model)
from veloscore.sources.sequence_model import demo_sequence_model, load_sequence_model
from veloscore.sources.series import read_series, series_from_table, write_series_csv
from veloscore.streaming.files import run_available, score_stream

#: Seconds since 2024-01-01 00:00:00 UTC are fed to the network when the label is scored.
LABEL_EPOCH = 1704067200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _events_series(spark: SparkSession, sf_dir: str, keep=("event_id",)) -> DataFrame:
    return series_from_table(_table(spark, sf_dir, "events"), keep=keep)


def _round8(c: str = "prediction"):
    return F.round(c, 8).alias(c)


# --- queries ---------------------------------------------------------------------------------

def q_series_from_csv(spark, sf_dir):
    """Events written as the reference's headerless CSV, read back with a schema."""
    path = write_series_csv(_events_series(spark, sf_dir, keep=()), scratch_path(spark, "series"))
    return read_series(spark, path)


def q_feature_label_split(spark, sf_dir):
    """Four key columns are the label range, four numeric columns the feature vector."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    s = split_features(li, 0, 3)
    return s.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    *[F.element_at("features", i).alias(f"f{i}") for i in range(1, 5)],
                    F.size("features").alias("n_features"))


def _score_scalar(spark, sf_dir, route, batch_size=5):
    s = scored(_events_series(spark, sf_dir), demo_scalar_model(), route=route,
               batch_size=batch_size, keep=("event_id",))
    return s.select("event_id", "unix_time", F.col("features").alias("value"), "key", _round8())


def q_score_scalar_native(spark, sf_dir):
    """M1 (route B) M2 P2 P3 on events."""
    return _score_scalar(spark, sf_dir, "native")


def q_score_scalar_udf(spark, sf_dir):
    """M1 (route A, batches of 5) M2 P2 P3 on events."""
    return _score_scalar(spark, sf_dir, "udf")


def _score_vector(spark, sf_dir, route):
    emb = tag_key(_table(spark, sf_dir, "embeddings"), "Predicted")
    s = score(emb, demo_vector_model(), features_col="embedding", route=route, batch_size=32)
    return s.select("vec_id", "label", "key", _round8())


def q_score_vector_native(spark, sf_dir):
    """M1 (route B) on 64-wide embeddings."""
    return _score_vector(spark, sf_dir, "native")


def q_score_vector_udf(spark, sf_dir):
    """M1 (route A) on 64-wide embeddings."""
    return _score_vector(spark, sf_dir, "udf")


_LI_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _score_lineitem(spark, sf_dir, route):
    li = _table(spark, sf_dir, "lineitem").select(*_LI_COLS)
    s = scored(li, demo_multi_model(), label_from=0, label_to=3, route=route, batch_size=64)
    return s.select("l_orderkey", "l_linenumber", "key", _round8())


def q_score_multi_native(spark, sf_dir):
    """P1 then M1 (route B): four label columns, four numeric columns as the feature vector."""
    return _score_lineitem(spark, sf_dir, "native")


def q_score_multi_udf(spark, sf_dir):
    """P1 then M1 (route A) on the same split."""
    return _score_lineitem(spark, sf_dir, "udf")


def q_score_label(spark, sf_dir):
    """The label (epoch seconds since 2024-01-01) is the scored value, key Occ_Predicted."""
    s = split_features(_events_series(spark, sf_dir), 0, 0, keep=("event_id",))
    s = tag_key(s, "Occ_Predicted").withColumn(
        "label_input", (F.col("unix_time") - F.lit(LABEL_EPOCH)).cast("double"))
    out = score(s, demo_scalar_model(), features_col="label_input")
    return out.select("event_id", "unix_time", "key", _round8())


def q_model_roundtrip(spark, sf_dir):
    """S4 then S3: publish the demo model as a Parquet table, load it back, score events."""
    path = publish_model(demo_scalar_model(), scratch_path(spark, "model"), spark)
    model = load_model(spark, path, "demo-1-3-1")
    s = scored(_events_series(spark, sf_dir), model, keep=("event_id",))
    return s.select("event_id", F.lit(model.model_id).alias("model_id"), _round8())


def q_predicted_int(spark, sf_dir):
    """Prediction and input truncated toward zero to INT."""
    s = scored(_events_series(spark, sf_dir), demo_scalar_model(), keep=("event_id",))
    return s.select("event_id", to_int("prediction").alias("predicted"),
                    to_int("features").alias("actual"))


def q_row_index(spark, sf_dir):
    """P5: gap-free row numbers in (ts, event_id) order, every column kept."""
    return row_index(_table(spark, sf_dir, "events"), ["ts", "event_id"], unique=True)


def q_report_lines(spark, sf_dir):
    """The reference's report, route B."""
    return score_and_report(_events_series(spark, sf_dir, keep=()), demo_scalar_model())


def q_report_lines_udf(spark, sf_dir):
    """J1 on route A with the reference's batch size of 5."""
    return score_and_report(_events_series(spark, sf_dir, keep=()), demo_scalar_model(),
                            route="udf", batch_size=5)


def q_report_vector(spark, sf_dir):
    """J1 on 64-wide vectors: rows numbered by vec_id, "Actual" is the first element."""
    emb = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    indexed = row_index(emb, ["vec_id"], unique=True)
    s = score(tag_key(indexed, "Predicted"), demo_vector_model(), features_col="embedding")
    return report(s, features_col="embedding", time_col="vec_id")


def q_report_lines_by_time(spark, sf_dir):
    """Report lines labelled by epoch seconds."""
    return score_and_report(_events_series(spark, sf_dir, keep=()), demo_scalar_model(),
                            by_time=True)


def q_saved_predictions(spark, sf_dir):
    """K1: report lines saved as text part files and read back."""
    rep = score_and_report(_events_series(spark, sf_dir, keep=()), demo_scalar_model())
    path = write_predictions(rep, scratch_path(spark, "predictions"), fmt="text")
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_scored_count(spark, sf_dir):
    """Records, scored rows and an order-independent prediction sum (route B)."""
    return scored_count(scored(_events_series(spark, sf_dir, keep=()), demo_scalar_model()))


def q_scored_count_udf(spark, sf_dir):
    """A1 J2 on route A."""
    return scored_count(scored(_events_series(spark, sf_dir, keep=()), demo_scalar_model(),
                               route="udf", batch_size=5))


def q_stream_report_by_time(spark, sf_dir):
    """S1 S2 M1 P6b as Structured Streaming: events written as four CSV files, scored one file
    per micro-batch into a Parquet sink, read back."""
    src = scratch_path(spark, "stream-in")
    write_series_csv(_events_series(spark, sf_dir, keep=()).repartition(4), src)
    out = scratch_path(spark, "stream-out")
    run_available(score_stream(spark, src, demo_scalar_model(), max_files_per_trigger=1),
                  out, scratch_path(spark, "stream-ckpt"))
    return spark.read.parquet(out)


def q_timed_runs(spark, sf_dir):
    """Three timed passes of route A scoring; times vary, rows do not."""
    pipeline = scored(_events_series(spark, sf_dir, keep=()), demo_scalar_model(), route="udf",
                      batch_size=5)
    return timed_runs(pipeline, 3)


def q_timed_run_rows(spark, sf_dir):
    """What a timed run scored, from the observed metrics of its tasks."""
    m = timed_stage(scored(_events_series(spark, sf_dir, keep=()), demo_scalar_model()))
    return spark.createDataFrame([(m["rows"], m["scored"])], "rows BIGINT, scored BIGINT")


def q_timed_runs_rows(spark, sf_dir):
    """J4 without its times: the rows of each of three passes."""
    pipeline = scored(_events_series(spark, sf_dir, keep=()), demo_scalar_model())
    return timed_runs(pipeline, 3).select("iteration", "rows")


def q_score_vector_relational(spark, sf_dir):
    """M1, third form, on 64-wide embeddings: the network is a table that is joined."""
    emb = tag_key(_table(spark, sf_dir, "embeddings"), "Predicted")
    model = publish_model(demo_vector_model(), scratch_path(spark, "model"), spark)
    s = score_relational(emb, model, features_col="embedding")
    return s.select("vec_id", "label", "key", _round8())


def q_score_multi_relational(spark, sf_dir):
    """P1 then M1, third form, in blocks of two inputs."""
    s = tag_key(split_features(_table(spark, sf_dir, "lineitem").select(*_LI_COLS), 0, 3), "Predicted")
    out = score_relational(s, demo_multi_model().to_frame(spark), block=2)
    return out.select("l_orderkey", "l_linenumber", "key", _round8())


def _classes(df):
    p = F.col("prediction")
    best = F.array_position(p, F.array_max(p)).cast("int").alias("best")
    return df.select("vec_id", *[F.round(F.get(p, F.lit(i)), 8).alias(f"p{i}") for i in range(3)], best)


def q_score_class_native(spark, sf_dir):
    """M1 (route B) with layer-wide activations: normalised hidden units, classes by softmax."""
    return _classes(score(_table(spark, sf_dir, "embeddings"), demo_class_model(), features_col="embedding"))


def q_score_class_udf(spark, sf_dir):
    """The same on route A."""
    return _classes(score(_table(spark, sf_dir, "embeddings"), demo_class_model(), features_col="embedding",
                          route="udf", batch_size=32))


def q_score_class_relational(spark, sf_dir):
    """The same as joins and sums, in blocks of 16 inputs."""
    emb = _table(spark, sf_dir, "embeddings")
    return _classes(score_relational(emb, demo_class_model().to_frame(spark), "embedding", block=16))


def _lineitem_features(spark, sf_dir):
    return split_features(_table(spark, sf_dir, "lineitem").select(*_LI_COLS), 0, 3)


def _score_normalised(spark, sf_dir, kind, route, **kw):
    s = _lineitem_features(spark, sf_dir)
    model = demo_multi_model()
    fitted = fit_normaliser(s, kind, width=model.n_inputs, **kw)
    path = publish_model(model.with_normaliser(fitted, f"demo-{kind}"), scratch_path(spark, "model"), spark)
    out = score(s, load_model(spark, path, f"demo-{kind}"), route=route, batch_size=64)
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


def q_score_standardised(spark, sf_dir):
    """P1 with a normaliser to mean 0 and deviation 1, stored with the network (route B)."""
    return _score_normalised(spark, sf_dir, "standardise", "native")


def q_score_minmax_udf(spark, sf_dir):
    """P1 with a normaliser to -1..1, stored with the network (route A)."""
    return _score_normalised(spark, sf_dir, "minmax", "udf", low=-1.0, high=1.0)


def q_feature_statistics(spark, sf_dir):
    """What a normaliser is fitted from, in one pass over four features."""
    s = feature_statistics(_lineitem_features(spark, sf_dir), width=4)
    return s.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "deviation")], "least", "most")


def q_class_labels(spark, sf_dir):
    """P1 with class labels: a dictionary of the return flags of shipped lines; other flags are unknown."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    dictionary = label_dictionary(li.where("l_returnflag <> 'N'"), "l_returnflag")
    out = encode_labels(li, dictionary, "l_returnflag", one_hot=True)
    hot = F.array_join(F.transform("label_one_hot", lambda x: x.cast("int").cast("string")), ",")
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "label_index", hot.alias("one_hot"))


def q_series_skip(spark, sf_dir):
    """S2 with a skip count: events in four files that begin with three lines of other text."""
    series = _events_series(spark, sf_dir, keep=("event_id",))
    part = F.pmod(F.col("event_id"), F.lit(4)).alias("part")
    lines = series.select(part, F.col("event_id").alias("place"), F.concat_ws(",", "unix_time", "value").alias("line"))
    names = F.array(F.lit("# events"), F.lit(""), F.lit("unix_time,value"))
    heads = lines.select("part").distinct().select("part", F.posexplode(names).alias("place", "line"))
    both = lines.union(heads.select("part", (F.col("place") - 3).cast("bigint"), "line"))
    path = scratch_path(spark, "series-skip")
    both.repartition("part").sortWithinPartitions("part", "place").select("part", "line").write.partitionBy("part").text(path)
    return read_series(spark, path, skip=3)


def q_score_attached(spark, sf_dir):
    """M2: a published network, read and built once by each worker from shared storage."""
    model = attach(spark, publish_model(demo_scalar_model(), scratch_path(spark, "model"), spark), "demo-1-3-1")
    split = split_features(_events_series(spark, sf_dir), 0, 0, keep=("event_id",))
    s = score_attached(tag_key(split, "Predicted"), model)
    return s.select("event_id", "unix_time", F.col("features").alias("value"), "key", _round8())


def _score_sequence(spark, sf_dir, route):
    """Each user's events in the order of time; the native route takes days as chunks."""
    events = _events_series(spark, sf_dir, keep=("event_id", "user_id"))
    path = publish_model(demo_sequence_model().to_frame(spark), scratch_path(spark, "model"))
    s = score_sequence(events, load_sequence_model(spark, path, "demo-gru-1-2-1"), ["user_id"], ["unix_time", "event_id"],
                       route=route, chunk=F.floor((F.col("unix_time") - LABEL_EPOCH) / (5 * 86400)))
    return s.select("event_id", "user_id", _round8())


def q_score_sequence_native(spark, sf_dir):
    """M1, recurrent layer (route B): states folded chunk after chunk."""
    return _score_sequence(spark, sf_dir, "native")


def q_score_sequence_udf(spark, sf_dir):
    """M1, recurrent layer (route A): states carried between batches."""
    return _score_sequence(spark, sf_dir, "udf")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "series_from_csv": q_series_from_csv,
    "feature_label_split": q_feature_label_split,
    "score_scalar_native": q_score_scalar_native,
    "score_scalar_udf": q_score_scalar_udf,
    "score_vector_native": q_score_vector_native,
    "score_vector_udf": q_score_vector_udf,
    "score_multi_native": q_score_multi_native,
    "score_multi_udf": q_score_multi_udf,
    "score_label": q_score_label,
    "model_roundtrip": q_model_roundtrip,
    "predicted_int": q_predicted_int,
    "row_index": q_row_index,
    "report_lines": q_report_lines,
    "report_lines_udf": q_report_lines_udf,
    "report_vector": q_report_vector,
    "report_lines_by_time": q_report_lines_by_time,
    "saved_predictions": q_saved_predictions,
    "scored_count": q_scored_count,
    "scored_count_udf": q_scored_count_udf,
    "stream_report_by_time": q_stream_report_by_time,
    "timed_runs": q_timed_runs,
    "timed_run_rows": q_timed_run_rows,
    "timed_runs_rows": q_timed_runs_rows,
    "score_vector_relational": q_score_vector_relational,
    "score_multi_relational": q_score_multi_relational,
    "score_class_native": q_score_class_native,
    "score_class_udf": q_score_class_udf,
    "score_class_relational": q_score_class_relational,
    "score_standardised": q_score_standardised,
    "score_minmax_udf": q_score_minmax_udf,
    "feature_statistics": q_feature_statistics,
    "class_labels": q_class_labels,
    "series_skip": q_series_skip,
    "score_attached": q_score_attached,
    "score_sequence_native": q_score_sequence_native,
    "score_sequence_udf": q_score_sequence_udf,
}


# --- oracle SQL (DuckDB) ---------------------------------------------------------------------

_SERIES = "(SELECT event_id, epoch_us(ts) // 1000000 AS unix_time, value FROM events)"


def _int_sql(x: str) -> str:
    return f"TRY_CAST(trunc(round({x}, 6)) AS INTEGER)"


def _scalar_sql(out_expr: str = "round({}, 8)") -> str:
    src = f"(SELECT event_id, unix_time, value, 'Predicted' AS key FROM {_SERIES} AS s)"
    return network_sql(demo_scalar_model(), src, "value", ["event_id", "unix_time", "value", "key"],
                       out_expr=out_expr)


def _vector_sql() -> str:
    src = "(SELECT vec_id, label, 'Predicted' AS key, embedding FROM embeddings)"
    return network_sql(demo_vector_model(), src, "embedding", ["vec_id", "label", "key"],
                       vector=True, out_expr="round({}, 8)")


def _line_sql(form: str, label: str) -> str:
    """A report line's format as a concatenation of its words and columns."""
    columns = iter((label, "key", "predicted", "actual"))
    parts = []
    for k, words in enumerate(form.replace("%s", "%d").split("%d")):
        if k:
            parts.append(f"coalesce(CAST({next(columns)} AS VARCHAR), 'null')")
        if words:
            parts.append(f"'{words}'")
    return " || ".join(parts)


def _report_sql(by_time: bool = False) -> str:
    indexed = (f"(SELECT unix_time, value, row_number() OVER (ORDER BY unix_time, value) "
               f"AS row_no FROM {_SERIES} AS s)")
    net = network_sql(demo_scalar_model(), indexed, "value", ["row_no", "unix_time", "value"],
                      out_expr="{}")
    line = _line_sql(TIME_LINE, "unix_time") if by_time else _line_sql(ROW_LINE, "row_no")
    return (f"SELECT row_no, unix_time, key, predicted, actual, {line} AS line FROM ("
            f"SELECT row_no, unix_time, 'Predicted' AS key, {_int_sql('prediction')} AS predicted, "
            f"{_int_sql('value')} AS actual FROM ({net}) AS n) AS r")


def _report_vector_sql() -> str:
    indexed = ("(SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS row_no "
               "FROM embeddings)")
    net = network_sql(demo_vector_model(), indexed, "embedding", ["row_no", "vec_id", "embedding"],
                      vector=True, out_expr="{}")
    return (f"SELECT row_no, vec_id, key, predicted, actual, {_line_sql(ROW_LINE, 'row_no')} AS line FROM ("
            f"SELECT row_no, vec_id, 'Predicted' AS key, {_int_sql('prediction')} AS predicted, "
            f"{_int_sql('embedding[1]')} AS actual FROM ({net}) AS n) AS r")


def _count_sql() -> str:
    return (f"SELECT count(*) AS records, count(prediction) AS scored, "
            f"CAST(sum(CAST(round(prediction, 8) AS DECIMAL(30,8))) AS DOUBLE) AS prediction_sum "
            f"FROM ({_scalar_sql('{}')}) AS p")


def _multi_sql() -> str:
    src = ("(SELECT l_orderkey, l_linenumber, 'Predicted' AS key, [CAST(l_quantity AS DOUBLE), "
           "CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] "
           "AS features FROM lineitem)")
    return network_sql(demo_multi_model(), src, "features", ["l_orderkey", "l_linenumber", "key"],
                       vector=True, out_expr="round({}, 8)")


def _class_sql() -> str:
    net = network_sql(demo_class_model(), "(SELECT vec_id, embedding FROM embeddings)", "embedding", ["vec_id"], vector=True)
    ps = ", ".join(f"round(prediction[{i + 1}], 8) AS p{i}" for i in range(3))
    return f"SELECT vec_id, {ps}, CAST(list_position(prediction, list_max(prediction)) AS INTEGER) AS best FROM ({net}) AS n"


_LI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _normalised_sql(kind: str) -> str:
    """The network on features that SQL itself normalises."""
    if kind == "standardise":
        stats = ", ".join(f"avg({c}) AS a{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_LI_FEATURES))
        feats = ", ".join(f"({c} - a{i}) * (CAST(1 AS DOUBLE) / s{i})" for i, c in enumerate(_LI_FEATURES))
    else:
        stats = ", ".join(f"min({c}) AS a{i}, max({c}) - min({c}) AS s{i}" for i, c in enumerate(_LI_FEATURES))
        feats = ", ".join(f"({c} - a{i}) * (CAST(2 AS DOUBLE) / s{i}) + CAST(-1 AS DOUBLE)" for i, c in enumerate(_LI_FEATURES))
    src = f"(SELECT l_orderkey, l_linenumber, [{feats}] AS features FROM lineitem, (SELECT {stats} FROM lineitem) AS t)"
    return network_sql(demo_multi_model(), src, "features", ["l_orderkey", "l_linenumber"], vector=True, out_expr="round({}, 6)")


def _statistics_sql() -> str:
    each = [f"SELECT {i} AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation, "
            f"min({c}) AS least, max({c}) AS most FROM lineitem" for i, c in enumerate(_LI_FEATURES)]
    return " UNION ALL ".join(each)


_LABELS_SQL = """
WITH d AS (SELECT l_returnflag AS label, row_number() OVER (ORDER BY l_returnflag) - 1 AS label_index
  FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag <> 'N')),
n AS (SELECT count(*) AS classes FROM d)
SELECT l_orderkey, l_linenumber, l_returnflag, label_index, CASE WHEN l_returnflag IS NULL THEN NULL ELSE
  array_to_string(list_transform(range(0, classes), lambda i: CASE WHEN i = label_index THEN '1' ELSE '0' END), ',') END AS one_hot
FROM lineitem LEFT JOIN d ON d.label = l_returnflag, n
"""


def oracle() -> dict[str, str]:
    label_src = (f"(SELECT event_id, unix_time, 'Occ_Predicted' AS key, "
                 f"CAST(unix_time - {LABEL_EPOCH} AS DOUBLE) AS label_input FROM {_SERIES} AS s)")
    report = _report_sql()
    return {
        "series_from_csv": "SELECT epoch_us(ts) // 1000000 AS unix_time, value FROM events",
        "feature_label_split": (
            "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
            "CAST(l_quantity AS DOUBLE) AS f1, CAST(l_extendedprice AS DOUBLE) AS f2, "
            "CAST(l_discount AS DOUBLE) AS f3, CAST(l_tax AS DOUBLE) AS f4, 4 AS n_features "
            "FROM lineitem"),
        "score_scalar_native": _scalar_sql(),
        "score_scalar_udf": _scalar_sql(),
        "score_vector_native": _vector_sql(),
        "score_vector_udf": _vector_sql(),
        "score_multi_native": _multi_sql(),
        "score_multi_udf": _multi_sql(),
        "score_label": network_sql(demo_scalar_model(), label_src, "label_input",
                                   ["event_id", "unix_time", "key"], out_expr="round({}, 8)"),
        "model_roundtrip": network_sql(
            demo_scalar_model(), f"(SELECT event_id, 'demo-1-3-1' AS model_id, value FROM {_SERIES} AS s)",
            "value", ["event_id", "model_id"], out_expr="round({}, 8)"),
        "predicted_int": (f"SELECT event_id, {_int_sql('prediction')} AS predicted, "
                          f"{_int_sql('value')} AS actual FROM ({_scalar_sql('{}')}) AS p"),
        "row_index": "SELECT *, row_number() OVER (ORDER BY ts, event_id) AS row_no FROM events",
        "report_lines": report,
        "report_lines_udf": report,
        "report_vector": _report_vector_sql(),
        "report_lines_by_time": _report_sql(by_time=True),
        "saved_predictions": f"SELECT line FROM ({report}) AS r",
        "scored_count": _count_sql(),
        "scored_count_udf": _count_sql(),
        "timed_run_rows": "SELECT count(*) AS rows, count(value) AS scored FROM events",
        "timed_runs_rows": ("SELECT CAST(i AS INTEGER) AS iteration, (SELECT count(*) FROM events) AS rows "
                            "FROM range(1, 4) AS t(i)"),
        "score_vector_relational": _vector_sql(),
        "score_multi_relational": _multi_sql(),
        "score_class_native": _class_sql(),
        "score_class_udf": _class_sql(),
        "score_class_relational": _class_sql(),
        "score_standardised": _normalised_sql("standardise"),
        "score_minmax_udf": _normalised_sql("minmax"),
        "feature_statistics": _statistics_sql(),
        "class_labels": _LABELS_SQL,
        "series_skip": "SELECT epoch_us(ts) // 1000000 AS unix_time, value FROM events",
        "score_attached": _scalar_sql(),
        **dict.fromkeys(("score_sequence_native", "score_sequence_udf"), sequence_sql(
            demo_sequence_model(), "(SELECT event_id, user_id, epoch_us(ts) // 1000000 AS unix_time, value FROM events)",
            "user_id", ["unix_time", "event_id"], "value", {"event_id": "BIGINT", "user_id": "BIGINT"}, out_expr="round({}, 8)")),
        "stream_report_by_time": (f"SELECT unix_time, key, predicted, actual, line "
                                  f"FROM ({_report_sql(by_time=True)}) AS r"),
    }
