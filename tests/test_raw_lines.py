import random
import re

from splitloom.sources.raw_lines import SPECS, failed_lines, load_lines, parse_lines

NUM = re.compile(r" *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *")


def cells_of(line):
    """Character by character; None for bad quoting."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            text, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            text, i = line[i:j], j
            if '"' in text:
                return None
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def reason(file, line):
    if file not in SPECS:
        return "unknown_file"
    cells = cells_of((line or "").rstrip(" \t\r\n"))
    spec = SPECS[file]
    if cells is None:
        return "quoting"
    if len(cells) != len(spec.columns):
        return "column_count"
    row = dict(zip(spec.columns, cells))
    if not row["id"].strip(" \t\r\n"):
        return "value"
    for c, (low, high) in spec.numbers.items():
        for x in row[c].split(","):
            if not NUM.fullmatch(x) or (low is not None and not float(x) > low) or (high is not None and not float(x) <= high):
                return "value"
    return None


FILES = ["dummy_constraints.tsv", "dummy_fraction_constraints.tsv"]
EDGE = [
    'u1\ts1\tp1\t0\t2.5', 'u1\t"s,1"\tp1\t0\t2.5', 'u1\t"a ""b"" c"\tp1\t0\t2.5', '"u\t1"\ts\tp\t0,1\t1,2', 'u\t"s"x\tp\t0\t1', 'u\ts"\tp\t0\t1', 'u\t"s\tp\t0\t1', '\ts\tp\t0\t1', 'u\ts\tp\t0\t1e', "u\ts\tp\t0\t+1.e1  \t\t",
    'u\ts\tp\t0\t"1.5"', 'u\ts\tp\t0\t""', '""\ts\tp\t0\t1', '"""', '"', '""', "", " \t ", None, "u\ts\tp\t0\t0", "u\ts\tp\t0\t-1", "u\ts\tp\t0\tNaN", "u\ts\tp\t\t1", 'u\t"s\n2"\tp\t0\t1\r\n', "u\ts\tp\t0\t1\t0.5", "u\ts\tp\t0\t1\t1.0000001", "u\ts\tp\t0\t1\t.5",
    'u\t"s""', 'u\t"s"""\tp\t0\t1', 'u\t""""\tp\t0\t1', "u\t" + "x" * 200_000 + "\tp\t0\t1", 'u\t"' + 'a""b\t' * 3000 + '"\tp\t0\t1', "\t" * 5000 + "x", '"' * 20_001,
]


def test_reasons_equal_a_plain_parser(spark):
    rng = random.Random(1)
    alphabet = ['"', '""', "\t", "a", "1", ",", ".5", " ", "\n", "e3", "-"]
    lines = EDGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(1500)]
    lines += ["\t".join(rng.choice(["u", '"u"', '"u\t"', "1", "0.5", '"1,2"', "", '"a"" b"']) for _ in range(rng.choice([4, 5, 6]))) for _ in range(1500)]
    rows = [(i, FILES[i % 2], x) for i, x in enumerate(lines)] + [(10**6, "other.tsv", "u\ts"), (10**6 + 1, None, "u")]
    df = spark.createDataFrame(rows, "line_id long, file_name string, raw_line string")
    got = {r["line_id"]: r["reason"] for r in failed_lines(df).collect()}
    want = {i: reason(f, x) for i, f, x in rows}
    assert {i: r for i, r in want.items() if r} == got
    loaded = [r["line_id"] for f in FILES for r in load_lines(df, f).collect()]
    assert sorted(loaded) == sorted(i for i, r in want.items() if not r)


def test_loaded_values(spark):
    rows = [(1, FILES[1], ' u1 \t"s1, s2"\t"a ""b"""\t0,1\t +2.50,3e1\t.5'), (2, FILES[1], ' u1 \t"s1, s2"\t"a ""b"""\t0,1\t +2.50,3e1\t.5'), (3, FILES[1], "u2\t\t\t1\t1\t1")]
    df = spark.createDataFrame(rows, "line_id long, file_name string, raw_line string").selectExpr("*", "1 AS id", "2 AS cells", "3 AS errors")
    got = sorted(tuple(r) for r in load_lines(df, FILES[1]).collect())
    first = ("u1", ["s1", "s2"], ['a "b"'], [0.0, 1.0], [2.5, 30.0], [0.5])
    assert got == [(1, *first), (2, *first), (3, "u2", [], [], [1.0], [1.0], [1.0])]


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id long, file_name string, raw_line string")
    assert failed_lines(df).count() == 0 and load_lines(df, FILES[0]).count() == 0 and parse_lines(df).count() == 0
