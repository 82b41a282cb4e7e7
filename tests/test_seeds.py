import random

import pytest
from pyarrow import fs

from pagelake.sources import seeds
from pagelake.streaming import flows


def test_every_part_size_gives_each_line_once(tmp_path):
    rng = random.Random(4)
    lines = ["x" * rng.choice([0, 1, 2, 5, 40]) + str(i) for i in range(60)]
    file = tmp_path / "a.txt"
    file.write_bytes("\n".join(lines).encode() + b"\ncut off")
    files = fs.LocalFileSystem()
    whole = seeds.last_line_end(files, str(file), 0, file.stat().st_size)
    assert whole == file.stat().st_size - len("cut off")
    for size in (1, 2, 3, 7, 50, 10_000):
        reader = seeds.SeedReader(str(tmp_path), size)
        end = reader.latestOffset()
        assert end == {str(file): whole}
        got = [line for part in reader.partitions({}, end) for _, line in seeds.lines_of(files, part)]
        assert [g.decode().rstrip("\n") for g in got] == lines
        # From a line's start in the middle of the file.
        low = len("\n".join(lines[:20])) + 1
        got = [line for part in reader.partitions({str(file): low}, end) for _, line in seeds.lines_of(files, part)]
        assert [g.decode().rstrip("\n") for g in got] == lines[20:]


def test_restart_takes_up_at_the_offset(spark, tmp_path):
    folder, out, ckpt = tmp_path / "list", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()

    def run():
        rows = flows.drain_to_files(seeds.stream_seeds(spark, str(folder), part_bytes=7), out, ckpt)
        return sorted((r["seed"], r["at"]) for r in rows.collect())

    (folder / "one.txt").write_text("https://x.test/a\r\n\n  https://x.test/ü  \nhttps://x.test/ha")
    (folder / ".hidden").write_text("no\n")
    (folder / "_SUCCESS").write_text("")
    first = run()
    assert [s for s, _ in first] == ["https://x.test/a", "https://x.test/ü"]
    assert run() == first  # nothing new
    with (folder / "one.txt").open("a") as f:
        f.write("lf\nhttps://x.test/a\n")
    (folder / "two.txt").write_text("https://y.test/\n")
    second = run()
    assert [s for s, _ in second] == ["https://x.test/a", "https://x.test/a", "https://x.test/half", "https://x.test/ü", "https://y.test/"]
    assert len(set(second)) == 5 and set(first) < set(second)


def test_refuses_parts_of_no_size(spark, tmp_path):
    with pytest.raises(ValueError):
        seeds.SeedSource({"path": str(tmp_path), "partBytes": "0"}).streamReader(None)
