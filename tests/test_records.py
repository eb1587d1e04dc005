"""The record source against a plain split of the whole text, at every range size."""

import gzip
import random
import re

import pytest

from treespark.sources import conllu
from treespark.sources.records import RecordReader, line_start, read_records, records_in, whole_reader


def plain(data: bytes) -> list[bytes]:
    parts, now = [], []
    for line in data.split(b"\n"):
        if line.strip(b" \t\r"):
            now.append(line)
        elif now:
            parts.append(b"\n".join(now))
            now = []
    return [p.strip(b"\r\n") for p in [*parts, *([b"\n".join(now)] if now else [])]]


@pytest.mark.parametrize("seed", range(12))
def test_every_range_size(tmp_path, seed):
    draw = random.Random(seed)
    ends = ["\n", "\r\n"][seed % 2]
    blank = lambda: "".join(draw.choice(" \t") for _ in range(draw.choice([0, 0, 1, 3])))
    text = ends.join([blank() for _ in range(draw.choice([0, 0, 2]))] + [
        x for _ in range(draw.choice([0, 1, 15])) for x in [
            *["w" * draw.randint(1, 9) for _ in range(draw.randint(1, 4))], *[blank() for _ in range(draw.randint(1, 3))]]
    ]) + draw.choice(["", "x", ends * 2])
    data = text.encode()
    path = tmp_path / "t.txt"
    path.write_bytes(data)
    ids = set()
    for size in (1, 2, 3, 7, 20, 64, 1000):
        reader = RecordReader({"paths": f'["{path}"]', "range": str(size)})
        rows = [(i, b) for p in reader.partitions() for x in reader.read(p) for i, b in zip(*[x.column(k).to_pylist() for k in (0, 2)])]
        assert [b.encode() for _, b in sorted(rows)] == [p.replace(b"\r", b"") for p in plain(data)], size
        ids.add(tuple(sorted(i for i, _ in rows)))
    assert len(ids) == 1


def test_long_gaps_and_lines():
    data = b"a\n" + b" \n" * 20_000 + b"b" * 50_000 + b"\n\nc"
    found = [r for start in range(0, len(data), 9000) for r in part(data, start, min(len(data), start + 9000))]
    assert [b[:1] + str(len(b)).encode() for _, b in found] == [b"a1", b"b50000", b"c1"]


def part(data, start, end):
    base = data.rfind(b"\n", 0, start) + 1
    at = [base]

    def read(n):
        at[0] += n
        return data[at[0] - n : at[0]]

    return records_in(read, base, start, end)


def test_files_of_a_tree(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.conllu").write_text("# s = 1\n1\tx\n \t\n1\ty\n\r\n\n1\tz", newline="")
    (tmp_path / "deep" / "b.conllu.gz").write_bytes(gzip.compress(b"1\tu\n\n1\tv\n"))
    (tmp_path / "deep" / "empty.conllu").write_text("")
    (tmp_path / "_SUCCESS").write_text("1\tno\n")
    rows = read_records(spark, str(tmp_path), range_bytes=4).collect()
    assert sorted(r.block for r in rows) == ["# s = 1\n1\tx", "1\tu", "1\tv", "1\ty", "1\tz"]
    assert len({r.sent_id for r in rows}) == 5
    assert conllu.read_conllu_forms(spark, str(tmp_path)).count() == 3  # the default pattern
    with pytest.raises(Exception, match="missing"):
        read_records(spark, str(tmp_path / "missing")).collect()


def test_blanked_lines_in_many_ranges(spark, tmp_path):
    text = "".join(f"# sent_id = {i}\n1\tw{i}\t_\t_\tX\t_\t0\troot\t_\t_\n{' ' * (i % 3)}\n" for i in range(3000))
    (tmp_path / "big.conllu").write_text(text)
    rows = read_records(spark, str(tmp_path / "big.conllu"), range_bytes=5000)
    assert rows.rdd.getNumPartitions() > 20
    assert {int(re.search(r"= (\d+)", r.block)[1]) for r in rows.collect()} == set(range(3000)) and rows.count() == 3000


def test_split_from_the_entry_name(spark, tmp_path):
    folder = tmp_path / "train.conllu-old"
    folder.mkdir()
    for s in ("train", "dev", "test"):
        (folder / f"xx-{s}.conllu").write_text("1\tx\t_\t_\tX\t_\t0\troot\t_\t_\n")
    rows = conllu.read_treebank(spark, str(folder)).collect()
    assert sorted(r.split for r in rows) == ["dev", "test", "train"]


def test_whole_reader_and_line_start(tmp_path):
    assert [b for _, b in records_in(whole_reader(b"\n\na\n\nb\n"), 0, 0, 7)] == [b"a", b"b"]
    from pyarrow import fs

    path = tmp_path / "t"
    path.write_bytes(b"x" * 10_000 + b"\n" + b"y" * 10_000)
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        assert (line_start(file, 9000), line_start(file, 15_000), line_start(file, 10_001)) == (0, 10_001, 10_001)
