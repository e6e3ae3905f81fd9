from pyspark.sql import functions as F

from papyra import extensions


def test_resolvers(spark):
    cited = spark.createDataFrame([(1, "doi", "a"), (2, "doi", "b"), (3, None, None), (4, "doi", "a")], "id int, scheme string, value string")
    twice = lambda ids: ids.where("value = 'a'").withColumn("path", F.explode(F.array(F.lit("/z"), F.lit("/y"))))
    other = lambda ids: ids.withColumn("path", F.lit("/other"))
    rows = extensions.resolved_by(cited, [twice, other]).orderBy("id").collect()
    assert [r.path for r in rows] == ["/y", "/other", None, "/y"]
    assert extensions.resolved_by(cited, []).where("path IS NOT NULL").count() == 0


def test_progress_of_a_stream(spark, tmp_path):
    told = []
    listener = extensions.Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    spark.range(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = stream.writeStream.format("memory").queryName("told").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    for _ in range(50):
        if told and told[-1][3]:
            break
        __import__("time").sleep(0.2)
    spark.streams.removeListener(listener)
    assert told[-1][3] and max(t[2] for t in told) == 50 and all(t[0] == "told" for t in told)


def test_commands(spark):
    commands = extensions.standard_commands()
    try:
        commands.add(extensions.Command("file.open", "x", "y"))
        raise AssertionError
    except ValueError:
        pass
    assert commands.table(spark).count() == len(commands.known)
