import pandas as pd

from tidemark.streaming import keyed


def admitted(times, limit, span):
    recent, out = [], []
    for t in times:
        recent = [r for r in recent if r > t - span]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def test_limiter_is_that_of_a_loop_over_all_events(spark, sf_dir):
    got = {r.event_id: r.admitted for r in keyed.limited(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    by_user, want = {}, {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r)
    for own in by_user.values():
        times = [int(pd.Timestamp(r.ts).value // 1000) for r in own]
        want |= dict(zip([r.event_id for r in own], admitted(times, 2, 6 * 3_600_000_000), strict=True))
    assert got == want and 0 < sum(want.values()) < len(want)


class Handle:
    """The state API as a processor sees it."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getListState(self, name, schema):
        own = self

        class State:
            def get(self):
                return iter(own.values.get(name, []))

            def put(self, rows):
                own.values[name] = rows

            def clear(self):
                own.values.pop(name, None)

        return State()

    def listTimers(self):
        return iter(set(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


def test_state_of_a_key_stays_bounded():
    handle, limiter = Handle(), keyed.Limiter(3, 10)
    limiter.init(handle)
    for k in range(200):
        rows = pd.DataFrame({"micros": [k * 1_000_000 + j for j in range(50)], "event_id": range(50)})
        list(limiter.handleInputRows(("u",), iter([rows[25:], rows[:25]]), None))
        assert len(handle.values["recent"]) <= 3 and len(handle.timers) == 1
    list(limiter.handleExpiredTimer(("u",), None, None))
    assert not handle.values


def test_streams_start_again_where_they_ended(spark, tmp_path):
    from tidemark.sources import hits

    root, out = tmp_path / "landed", str(tmp_path / "seen")
    (root / "source=web").mkdir(parents=True)
    hits.register(spark)

    def run():
        stream = spark.readStream.format("hits").load(str(root)).writeStream.format("parquet").option("path", out)
        stream.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.title for r in spark.read.schema(hits.SCHEMA).parquet(out).collect())

    (root / "source=web" / "0001.json").write_text('{"title": "a", "url": "u"}\nno json\n{"title": "", "url": "u"}\n')
    assert run() == ["a"]
    (root / "source=web" / "0002.json").write_text('{"title": "b", "url": "v", "published": "2024-01-02T03:04:05+00:00"}')
    assert run() == ["a", "b"] and run() == ["a", "b"]
