"""Work that is lost midway goes on from its last commit."""

import sys

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark import cloudpickle

from histloom.operators import progress as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import tests


class Lost(BaseException):
    pass


def rows(spark, n=200):
    return spark.range(n).selectExpr("id as k", "case when id % 50 = 7 then ' ' else 'text ' || id end as t")


def counted(root, limit=None):
    """A function that notes each call as a file, and is lost once after `limit` calls."""

    def call(text):
        system, path = fs.FileSystem.from_uri(root)
        seen = system.get_file_info(fs.FileSelector(f"{path}/calls", allow_not_found=True))
        if limit is not None and len(seen) >= limit and not system.get_file_info(f"{path}/lost").is_file:
            system.open_output_stream(f"{path}/lost").close()
            raise Lost("gone")
        system.create_dir(f"{path}/calls", recursive=True)
        again = sum(f.base_name.startswith(f"{text}-") for f in seen)
        system.open_output_stream(f"{path}/calls/{text}-{again}").close()
        if text.endswith("9"):
            raise ValueError("nine")
        return text.upper()

    return call


def expected(n=200):
    out = {}
    for i in range(n):
        blank, nine = i % 50 == 7, i % 10 == 9
        out[i] = ("", "error", "empty input") if blank else ("", "error", "nine") if nine else (f"TEXT {i}", "success", None)
    return out


def test_whole_run_and_rerun(spark, tmp_path):
    root = str(tmp_path / "p")
    for _ in range(2):
        got = P.enrich_with_progress(rows(spark), "k", "t", counted(root), root, every=7, ranges=4)
        assert {r.k: tuple(r)[1:] for r in got.collect()} == expected()
    assert len(list((tmp_path / "p" / "calls").iterdir())) == 196


def test_no_committed_key_is_called_again(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(Exception, match="gone"):
        P.enrich_with_progress(rows(spark), "k", "t", counted(root, 60), root, every=5, ranges=3)
    before = {r.k for r in P.results(spark, root, "k", "bigint").collect()}
    assert 0 < len(before) < 200
    got = P.enrich_with_progress(rows(spark), "k", "t", counted(root, 60), root, every=5, ranges=2)
    assert {r.k: tuple(r)[1:] for r in got.collect()} == expected()
    calls = [f.name for f in (tmp_path / "p" / "calls").iterdir()]
    twice = {int(c.split(" ")[1].split("-")[0]) for c in calls if c.endswith("-1")}
    assert not twice & before and not any(c.endswith("-2") for c in calls)
    assert P.progress(spark, root, "k", "bigint").count() == 200


def test_only_named_data_counts(spark, tmp_path):
    root = str(tmp_path / "p")
    P.enrich_with_progress(rows(spark, 20), "k", "t", str.upper, root, every=3, ranges=2)
    entries = sorted((tmp_path / "p" / "manifest").rglob("*.json"))
    entries[0].unlink()  # as if its writer had been lost between the two steps
    left = {r.k for r in P.results(spark, root, "k", "bigint").collect()}
    assert 0 < len(left) < 20
    again = P.enrich_with_progress(rows(spark, 20), "k", "t", lambda t: t.upper() + "!", root, every=3, ranges=2)
    values = {r.k: r.value for r in again.collect()}
    assert values == {i: "" if i == 7 else f"TEXT {i}" + ("" if i in left else "!") for i in range(20)}


def test_two_attempts_that_both_committed(spark, tmp_path):
    root = str(tmp_path / "p")
    for name in ("data", "started", "manifest"):
        (tmp_path / "p" / name).mkdir(parents=True)
    for attempt, value in (("b", "second"), ("a", "first")):
        table = pa.table({"k": [1], "value": [value], "status": ["success"], "error": pa.array([None], pa.string())})
        P.commit(fs.LocalFileSystem(), root, table, 0, attempt, 0)
    assert [tuple(r) for r in P.results(spark, root, "k", "bigint").collect()] == [(1, "first", "success", None)]
    assert P.progress(spark, root, "k", "bigint").count() == 2


def test_empty_table(spark, tmp_path):
    root = str(tmp_path / "p")
    assert P.enrich_with_progress(rows(spark, 0), "k", "t", str.upper, root).count() == 0
