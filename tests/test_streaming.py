"""Streams with one file a batch."""

from pyspark.sql import functions as F

from brookmill.sources.merge import upsert_add
from brookmill.sources.readers import read_ad_stream_files
from brookmill.sources.tables import EpochTable, Folder
from brookmill.streaming import ads


def write_lines(folder, batches):
    folder.mkdir()
    for i, lines in enumerate(batches):
        (folder / f"{i:03d}.txt").write_text("".join(f"{x}\n" for x in lines))
        import os

        os.utime(folder / f"{i:03d}.txt", (1_700_000_000 + i, 1_700_000_000 + i))


def line(clock, user=7, ad=1):
    h, m, s = map(int, clock.split(":"))
    return f"{1704067200000 + ((h * 60 + m) * 60 + s) * 1000} P C {user} {ad}"


def trend(spark, tmp_path, clocks):
    write_lines(tmp_path / "in", [[line(c)] for c in clocks])
    table = EpochTable(spark, f"file://{tmp_path}/t", ads.AD_TREND)
    clicks = read_ad_stream_files(spark, f"file://{tmp_path}/in", 1)
    ads.keep_latest(ads.ad_click_trend_stream(clicks), table, ["date", "hour", "minute", "ad_id"], f"file://{tmp_path}/c").awaitTermination(120)
    return {f"{r['hour']}:{r['minute']}": r["click_count"] for r in table.read(table.last).collect()}


def test_late_row_is_dropped(spark, tmp_path):
    got = trend(spark, tmp_path, ["10:00:00", "12:30:00", "12:31:00", "10:00:10", "11:45:00"])
    assert got["10:00"] == 1 and got["11:45"] == 1


def test_watermark_acts_one_batch_later(spark, tmp_path):
    assert trend(spark, tmp_path, ["10:00:00", "12:30:00", "10:00:10"])["10:00"] == 2


def test_blacklist_loop_and_replay(spark, tmp_path):
    write_lines(tmp_path / "in", [[line("10:00:00")] * 99, [line("10:00:01")], [line("10:00:02")] * 5])
    counts = EpochTable(spark, f"file://{tmp_path}/n", ads.USER_AD, keep=9)
    listed = EpochTable(spark, f"file://{tmp_path}/l", ads.LISTED, None, keep=9)
    ads.blacklist_stream(read_ad_stream_files(spark, f"file://{tmp_path}/in", 1), counts, listed, f"file://{tmp_path}/c").awaitTermination(120)
    assert listed.read(0).count() == 0 and [r[0] for r in listed.read(1).collect()] == [7]
    assert counts.read(2).first()["click_count"] == 100
    # the second batch once more, with the same epoch
    rows = spark.createDataFrame([(7, 1)], "user_id long, ad_id long").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 10:00:01")))
    ads.count_users(rows, counts, listed, 1, 100)
    assert counts.read(1).first()["click_count"] == 100 and [r[0] for r in listed.read(1).collect()] == [7]


def test_blacklist_counts_each_ad_alone(spark):
    clicks = spark.createDataFrame([(7, 1 + i % 2) for i in range(120)], "user_id long, ad_id long").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    empty = spark.createDataFrame([], "user_id long")
    _, listed = ads.update_blacklist(clicks, spark.createDataFrame([], ads.USER_AD), empty)
    assert listed.count() == 0


def test_job_goes_on_after_a_restart(spark, tmp_path):
    write_lines(tmp_path / "in", [[line("10:00:00")] * 99, [line("10:00:01")]])
    clicks = read_ad_stream_files(spark, f"file://{tmp_path}/in", 1)
    running, _ = ads.ad_job_stream(clicks, f"file://{tmp_path}/job")
    running.awaitTermination(120)
    write_lines(tmp_path / "more", [[line("10:00:02")] * 5 + [line("10:00:02", user=8)] * 2])
    (tmp_path / "more" / "000.txt").rename(tmp_path / "in" / "009.txt")
    running, tables = ads.ad_job_stream(read_ad_stream_files(spark, f"file://{tmp_path}/in", 1), f"file://{tmp_path}/job", interval="1 second")
    running.processAllAvailable()
    running.stop()
    assert tables["listed"].last == 2 and [r[0] for r in tables["listed"].read(2).collect()] == [7]
    assert [r["click_count"] for r in tables["stat"].read(2).collect()] == [102] == [r["click_count"] for r in tables["tops"].read(2).collect()]
    again = EpochTable(spark, f"file://{tmp_path}/job/stat", ads.AD_STAT)
    assert again.epochs == [1, 2] and again.read().count() == 1


# --- tables that change epoch by epoch ----------------------------------------------------------


def stat_rows(spark, rows):
    return spark.createDataFrame([(d, "P", "C", a, n) for d, a, n in rows], ads.AD_STAT)


def add(table, rows, epoch):
    return table.merge(rows, epoch, lambda current, new: upsert_add(current, new, ads.STAT_KEYS, "click_count"))


def content(df):
    return sorted((r["date"] or "", r["ad_id"], r["click_count"]) for r in df.collect())


def test_an_epoch_writes_what_it_touches(spark, tmp_path):
    """Twenty epochs over twenty dates: the bytes written follow the batch, not the table."""
    table = EpochTable(spark, f"file://{tmp_path}/t", ads.AD_STAT)
    add(table, stat_rows(spark, [(f"2024-01-{d:02d}", a, 1) for d in range(1, 21) for a in range(50)]), 0)
    whole = table.bytes_written(0)
    written = []
    for epoch in range(1, 21):
        assert add(table, stat_rows(spark, [(f"2024-01-{epoch:02d}", a, 1) for a in range(50)]), epoch) == [f"date=2024-01-{epoch:02d}"]
        written.append(table.bytes_written(epoch))
    assert max(written) < 1.2 * min(written) and max(written) < whole / 15
    assert content(table.read()) == [(f"2024-01-{d:02d}", a, 2) for d in range(1, 21) for a in range(50)]
    # the epoch before is still there, those before it and what they alone held are gone
    assert content(table.read(19))[-1] == ("2024-01-20", 49, 1) and table.epochs == [19, 20]
    assert len(Folder(spark, f"file://{tmp_path}/t").names("data/write=0")) < 4


def test_an_epoch_that_runs_again_gives_the_same(spark, tmp_path):
    table = EpochTable(spark, f"file://{tmp_path}/t", ads.AD_STAT)
    first, second = [("2024-01-01", 1, 5), (None, 2, 1)], [("2024-01-01", 1, 7), ("2024-01-02", 3, 1), (None, 2, 1)]
    add(table, stat_rows(spark, first), 0)
    for _ in range(3):
        add(table, stat_rows(spark, second), 1)
        assert content(table.read()) == [("", 2, 2), ("2024-01-01", 1, 12), ("2024-01-02", 3, 1)]
    # one that stopped before its manifest left only files that nobody reads
    table.files.delete("manifest/1.json")
    assert content(table.read()) == [("", 2, 1), ("2024-01-01", 1, 5)]
    add(table, stat_rows(spark, second), 1)
    add(table, stat_rows(spark, []), 2)
    assert content(table.read()) == [("", 2, 2), ("2024-01-01", 1, 12), ("2024-01-02", 3, 1)] and table.last == 2


def test_appended_folders_are_compacted(spark, tmp_path):
    table = EpochTable(spark, f"file://{tmp_path}/t", ads.AD_STAT)
    for epoch in range(6):
        table.append(stat_rows(spark, [("2024-01-01", epoch, 1), (f"2024-01-{epoch + 2:02d}", epoch, 1)]), epoch)
    before = content(table.read())
    assert len(table._manifest(5)["date=2024-01-01"]) == 6
    assert table.compact() == 1 and table.compact() == 0
    assert content(table.read()) == before and len(table._manifest(5)["date=2024-01-01"]) == 1
    table.append(stat_rows(spark, [("2024-01-01", 9, 1)]), 6)
    assert len(content(table.read())) == len(before) + 1 and content(table.read(5)) == before
    users = EpochTable(spark, f"file://{tmp_path}/u", ads.LISTED, None)
    for epoch in range(3):
        users.append(spark.createDataFrame([(epoch,)], ads.LISTED), epoch)
    assert users.compact() == 1 and sorted(r[0] for r in users.read().collect()) == [0, 1, 2]


# --- the chain of two queries ----------------------------------------------------------------------


def put(tmp_path, i, lines):
    import os

    (tmp_path / "in").mkdir(exist_ok=True)
    path = tmp_path / "in" / f"{i:03d}.txt"
    path.write_text("".join(f"{x}\n" for x in lines))
    os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def day_line(day, user=7, ad=1, clock="10:00:00"):
    h, m, s = map(int, clock.split(":"))
    return f"{1704067200000 + (day - 1) * 86_400_000 + ((h * 60 + m) * 60 + s) * 1000} P C {user} {ad}"


def chain(spark, tmp_path, **first):
    folder = f"file://{tmp_path}/job"
    ads.filtered_clicks_stream(read_ad_stream_files(spark, f"file://{tmp_path}/in", 1), folder, threshold=3, **first).awaitTermination(200)
    second, tables = ads.filtered_stat_stream(spark, folder)
    second.awaitTermination(200)
    return tables, ads.chain_tables(spark, folder), second


def test_chain_counts_what_passed_and_keeps_the_late(spark, tmp_path):
    """Five batches, both queries started anew after each: input = passed + of listed users + late."""
    batches = [
        [day_line(1, user=7)] * 3 + [day_line(1, user=8)],  # user 7 reaches the threshold
        [day_line(1, user=7), day_line(2, user=8)],  # and is filtered
        [day_line(5, user=9)] * 2,
        [day_line(1, user=8), day_line(3, user=8), day_line(4, user=8), day_line(5, user=7), "bad line"],  # 1 and 3 January are over
        [day_line(6, user=9, ad=2)],
    ]
    for i, lines in enumerate(batches):
        put(tmp_path, i, lines)
        stat, kept, _ = chain(spark, tmp_path)
    assert content(stat["stat"].read()) == [("2024-01-01", 1, 4), ("2024-01-02", 1, 1), ("2024-01-04", 1, 1), ("2024-01-05", 1, 2), ("2024-01-06", 2, 1)]
    assert content(stat["tops"].read()) == content(stat["stat"].read())
    late = {r["date"]: r["late_count"] for r in ads.late_counts(kept["late"].read()).collect()}
    assert late == {"2024-01-01": 1, "2024-01-03": 1, None: 1}
    assert [r[0] for r in kept["listed"].read().collect()] == [7]
    counted, filtered = sum(n for _, _, n in content(stat["stat"].read())), 2
    assert sum(map(len, batches)) == counted + filtered + sum(late.values())


def test_state_of_past_days_goes(spark, tmp_path):
    for i, day in enumerate((1, 2, 10, 11, 20)):
        put(tmp_path, i, [day_line(day, user=u, ad=u) for u in range(5)])
    _, _, second = chain(spark, tmp_path)
    put(tmp_path, 9, [day_line(21, user=1)])
    tables, _, second = chain(spark, tmp_path)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in second.recentProgress if p["stateOperators"]]
    assert rows[-1] <= 6 and tables["stat"].read().count() == 26  # only the last days are state; the table has all


def test_an_epoch_of_the_chain_that_runs_again(spark, tmp_path):
    """The process stops after the move but before Spark notes the batch, or before the move."""
    put(tmp_path, 0, [day_line(1, user=7)] * 2)
    put(tmp_path, 1, [day_line(1, user=8)] * 2)
    stat, kept, _ = chain(spark, tmp_path)
    expected = content(stat["stat"].read())
    (tmp_path / "job" / "checkpoint-filter" / "commits" / "1").unlink()
    for crc in (tmp_path / "job" / "checkpoint-filter" / "commits").glob(".1*"):
        crc.unlink()
    stat, kept, _ = chain(spark, tmp_path)
    assert content(stat["stat"].read()) == expected == [("2024-01-01", 1, 4)]
    # a third batch whose tables were written, but whose folder was not moved
    put(tmp_path, 2, [day_line(1, user=7)])
    folder = f"file://{tmp_path}/job"
    ads.filtered_clicks_stream(read_ad_stream_files(spark, f"file://{tmp_path}/in", 1), folder, threshold=3).awaitTermination(200)
    (tmp_path / "job" / "filtered" / "epoch=2").rename(tmp_path / "gone")
    for file in [tmp_path / "job" / "checkpoint-filter" / "commits" / "2", *(tmp_path / "job" / "checkpoint-filter" / "commits").glob(".2*")]:
        file.unlink()
    stat, kept, _ = chain(spark, tmp_path)
    assert content(stat["stat"].read()) == [("2024-01-01", 1, 5)]
    assert {(r["user_id"], r["click_count"]) for r in kept["user_counts"].read().collect()} == {(7, 3), (8, 2)} and [r[0] for r in kept["listed"].read().collect()] == [7]


def test_late_split(spark):
    rows = spark.createDataFrame([("2024-01-01 23:59:59",), ("2024-01-02 00:00:00",), (None,)], "ts string").withColumn("ts", F.to_timestamp("ts"))
    mark = spark.sql("SELECT TIMESTAMP '2024-01-02 00:00:00' AS t").first()[0]
    on_time, late = ads.split_late(rows, mark)
    assert on_time.count() == 1 and late.count() == 2
    assert ads.split_late(rows, None)[0].count() == 2


def test_whole_job_until_it_is_stopped(spark, tmp_path):
    """Three queries at once over batches that arrive while they run."""
    put(tmp_path, 0, [day_line(1, user=7)] * 3)
    clicks = read_ad_stream_files(spark, f"file://{tmp_path}/in", 1)
    running, tables = ads.start_realtime_job(clicks, f"file://{tmp_path}/job", threshold=3, interval="1 second")
    try:
        running[0].processAllAvailable()
        put(tmp_path, 1, [day_line(1, user=7, clock="10:01:00"), day_line(1, user=8, clock="10:01:00")])
        for query in running:
            query.processAllAvailable()
        running[1].processAllAvailable()
    finally:
        for query in running:
            query.stop()
    assert content(tables["stat"].read()) == [("2024-01-01", 1, 4)] == content(tables["tops"].read())
    trend = {f"{r['hour']}:{r['minute']}": r["click_count"] for r in tables["trend"].read().collect()}
    assert trend == {"10:00": 3, "10:01": 2}  # of all clicks, those of the listed user too
    assert [r[0] for r in tables["listed"].read().collect()] == [7]
