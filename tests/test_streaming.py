from lifeloom.streaming.lifecycle_stream import close_lifecycles


def test_stream_closes_what_disappears(spark, tmp_path):
    schema = "page string, ord long, ts timestamp, user string, triples array<struct<p:string,o:string>>"
    base = "SELECT 'x' AS page, {o}L AS ord, TIMESTAMP '2024-01-0{o} 00:00:00' AS ts, 'u{o}' AS user, CAST({t} AS array<struct<p:string,o:string>>) AS triples"
    for o, t in ((1, "array(struct('p', 'a'), struct('p', 'b'))"), (2, "array(struct('p', 'b'))"), (3, "array()")):
        spark.sql(base.format(o=o, t=t)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    done = close_lifecycles(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination()
    got = sorted((r.o, r.cuser, r.duser) for r in spark.table("closed").collect())
    assert got == [("a", "u1", "u2"), ("b", "u1", "u3")]
