import json

import pytest

from packetflow.operators import consensus as V
from packetflow.sources import providers, sinks
from packetflow.sources.tables import table
from packetflow.streaming import landing


def test_providers(spark):
    p = providers.create("lookup", answers={"a": {"x": 1}})
    rows = {r.k: r for r in providers.answers(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k", p, 2, retries=1, base_delay=0.01).collect()}
    assert json.loads(rows["a"].answer) == {"x": 1} and rows["b"].status == "failed" and rows["b"].attempts == 2 and 0.01 <= rows["b"].waited < 0.02 and rows[None].error == "no input"
    with pytest.raises(ValueError):
        providers.create("nobody")


def test_delays_and_usage(spark):
    class ReadTimeout(Exception): ...

    assert providers.is_transient(ReadTimeout()) and providers.is_transient(OSError("Connection reset by peer")) and not providers.is_transient(ValueError("bad"))
    assert [providers.delay_seconds(n, 1.0, t) for n, t in ((0, False), (2, False), (2, True))] == [1.0, 4.0, 12.0] and providers.delay_seconds(3, 10.0, True, 1.0) == 245.0
    rows = ['{"input_tokens": 7, "output_tokens": 2, "total_tokens": 9, "input_tokens_details": {"cached_tokens": 3}}', '{"prompt_token_count": 7, "candidates_token_count": 2, "cached_content_token_count": null}', '{"input_tokens": 7, "output_tokens": 2}', None, "[]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, u string")
    got = [tuple(r.x)[:4] for r in df.select("i", providers.usage(df.u, df.u).alias("x")).orderBy("i").collect()]
    assert got == [(7, 2, 9, 3), (7, 2, 9, 0), (7, 2, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "f", "v", 0.5, True), (1, "g", None, 0.5, True)], "packet_id bigint, field_name string, value string, confidence double, review_required boolean")
    assert json.loads(sinks.consolidated_json(df).first().record_json) == {"f": {"value": "v", "confidence": 0.5, "review_required": True}}
    sinks.write_by_packet(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_landing(spark, data, tmp_path):
    source = table(spark, data, "field_variants")
    source.filter("packet_id <= 20").write.parquet(str(tmp_path / "in/a"))
    got = {}
    query = landing.consolidate_touched(landed := landing.landed(spark, str(tmp_path / "in/a"), source.schema), lambda: source, lambda df, epoch: got.setdefault(epoch, df.collect()), str(tmp_path / "ck"))
    query.awaitTermination(120)
    counts = V.values(V.variants(source.filter("packet_id <= 20")))
    assert landed.isStreaming and sorted(map(tuple, got[0])) == sorted(map(tuple, V.scored(counts, V.plurality(counts)).collect()))


def test_windowed_counts(spark, data, tmp_path):
    source = table(spark, data, "field_variants")
    source.write.parquet(str(tmp_path / "in"))
    query = landing.loads_by_hour(landing.landed(spark, str(tmp_path / "in"), source.schema)).writeStream.outputMode("complete").format("memory").queryName("loads").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select sum(n_rows) from loads").first()[0] == source.count()
