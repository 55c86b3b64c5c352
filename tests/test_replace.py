"""A table that is replaced is the old or the new one, wherever the writer stops."""

import pytest
from nichewright.sources import bundle


class Stop(Exception):
    pass


class Broken:
    """A file system that stops ahead of one of its calls; the others go through."""

    def __init__(self, fs, call: str, at: int):
        self.fs, self.call, self.left = fs, call, at

    def __getattr__(self, name):
        def run(*args):
            if name == self.call:
                self.left -= 1
                if self.left < 0:
                    raise Stop
            return getattr(self.fs, name)(*args)

        return run


def values(spark, path):
    return sorted(r.id for r in bundle.read_bundle(spark, path, ("t",))["t"].collect())


@pytest.mark.parametrize(("call", "at", "left"), [("rename", 0, [0, 1]), ("rename", 1, [0, 1]), ("delete", 0, [0, 1, 2])])
def test_a_writer_that_stops_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, call, at, left):
    path, real = str(tmp_path), bundle._fs
    bundle.write_table(spark.range(2), f"{path}/t")
    with monkeypatch.context() as patch:
        patch.setattr(bundle, "_fs", lambda s, p: (Broken(real(s, p)[0], call, at), real(s, p)[1]))
        with pytest.raises(Stop):
            bundle.write_table(spark.range(3), f"{path}/t")
    assert values(spark, path) == left
    bundle.write_table(spark.range(4), f"{path}/t")
    assert values(spark, path) == [0, 1, 2, 3] and not list(tmp_path.glob("t.old-*"))


def test_a_table_made_from_itself_after_a_stop(spark, tmp_path):
    path = str(tmp_path)
    bundle.write_table(spark.range(3), f"{path}/t")
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    assert bundle.table_path(spark, f"{path}/t").endswith("t.old-1") and bundle.table_path(spark, f"{path}/none") is None
    held = bundle.read_bundle(spark, path, ("t",))["t"]
    bundle.write_table(held.where("id > 0"), f"{path}/t")
    assert values(spark, path) == [1, 2]


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(KeyError):
        bundle.read_bundle(spark, str(tmp_path), ("t",))
