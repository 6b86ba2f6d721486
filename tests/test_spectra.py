import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import Settings, parse
from ionweave.functions import peaks as P
from ionweave.functions.natural import natural_key
from ionweave.operators import blocking, clustering, preprocess, similarity
from ionweave.plans import pipeline
from ionweave.sinks import writers
from ionweave.sources.readers import read_spectra
from ionweave.storage import Scratch, numbered

SCHEMA = "sid long, identifier string, precursor_mz double, precursor_charge byte, peaks array<struct<mz:double,intensity:double>>, retention_time double, filename string"


def spectra(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", mz, z, None if peaks is None else [(float(m), float(x)) for m, x in peaks], rt, "f.mgf") for i, (mz, z, peaks, rt) in enumerate(rows)], SCHEMA)


def wide(n=6, scale=1.0):
    return [(200.0 + 100 * i, scale * (10.0 + i)) for i in range(n)]


def test_get_dim():
    n, low, high = P.get_dim(101.0, 1500.0, 0.05)
    assert (n, round(low, 2), round(high, 2)) == (27982, 100.95, 1500.0)


def test_validity(spark):
    s = Settings(remove_precursor_tol=None, min_intensity=None, max_peaks_used=None)
    rows = [(300.0, 2, wide(4), 0.0), (300.0, 2, [(200 + x, 1.0) for x in (0, 50, 100, 150, 249.9)], 0.0), (300.0, 2, [(200 + x, 1.0) for x in (0, 50, 100, 150, 250.0)], 0.0), (300.0, 2, [], 0.0), (300.0, 2, None, 0.0)]
    got = preprocess.process_spectra(spectra(spark, rows), s).orderBy("sid").collect()
    assert [r["valid"] for r in got] == [False, False, True, False, False]
    assert got[0]["peaks"] is None
    assert sum(p["intensity"] ** 2 for p in got[2]["peaks"]) == pytest.approx(1)


def test_steps(spark):
    peaks = [(100.0, 5.0), (200.0, 0.5), (300.0, 100.0), (400.0, 50.0), (500.0, 50.0), (599.2, 70.0)]
    df = spectra(spark, [(300.0, 2, peaks, 0.0), (300.0, None, peaks, 0.0)])
    p, q = F.col("peaks"), F.col("precursor_charge")
    run = lambda e: [[x["mz"] for x in r["p"]] for r in df.select("sid", e.alias("p")).orderBy("sid").collect()]
    assert run(P.in_range(p, 200.0, 500.0))[0] == [200.0, 300.0, 400.0, 500.0]
    assert run(P.without_precursor(p, F.col("precursor_mz"), q, 1.5)) == [[100.0, 200.0, 400.0, 500.0], [100.0, 200.0, 400.0, 500.0, 599.2]]
    assert run(P.above(p, 0.005))[0] == [100.0, 300.0, 400.0, 500.0, 599.2]
    assert run(P.top_k(p, 3))[0] == [300.0, 400.0, 599.2]  # equal intensities: the smaller m/z
    ranks = df.select(P.scaled(p, "rank", 50).alias("p")).first()["p"]
    assert [x["intensity"] for x in ranks] == [46.0, 45.0, 50.0, 48.0, 47.0, 49.0]
    assert [round(x["intensity"], 3) for x in df.select(P.scaled(p, "log").alias("p")).first()["p"]][:2] == [2.585, 0.585]


def test_blocks_gap_and_charge(spark):
    rows = [(400.0, 1, [], 0.0), (400.008, 1, [], 0.0), (400.0161, 1, [], 0.0), (500.0, 1, [], 0.0), (400.0, None, [], 0.0), (999.999, 1, [], 0.0), (1000.001, 1, [], 0.0)]
    got = {r["sid"]: r["block_id"] for r in blocking.with_blocks(spectra(spark, rows), 20.0, "ppm", 32, ["sid"]).collect()}
    assert got[0] == got[1] != got[2]
    assert got[4] != got[0]
    assert got[5] == got[6]  # neighbours in different bins of m/z
    got = {r["sid"]: r["block"] for r in blocking.with_blocks(spectra(spark, [(1.0, 1, [], 0.0), (1.5, 1, [], 0.0), (2.25, 1, [], 0.0)]), 0.5, "Da", 32, ["sid"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


@pytest.mark.parametrize("exempt", [False, True])
def test_large_blocks_are_cut(spark, exempt):
    rows = [(400.0, 1, [], 0.0)] * 65 + [(500.0, 1, [], 0.0)] * 65
    df = blocking.with_blocks(spectra(spark, rows), 20.0, "ppm", 32, ["sid"], exempt_last=exempt)
    got = sorted((r["block"], r["chunk"], r["count"]) for r in df.groupBy("block", "chunk").count().collect())
    cut = [(0, 22), (1, 22), (2, 21)]
    assert got == [(0, *c) for c in cut] + ([(1, 0, 65)] if exempt else [(1, *c) for c in cut])
    assert [r["sid"] for r in df.where("block = 0 and chunk = 0").orderBy("sid").collect()] == list(range(22))


def test_scores(spark):
    unit = lambda *p: [(m, x / np.sqrt(sum(v * v for _, v in p))) for m, x in p]
    rows = [
        (400.0, 1, unit((100.0, 1.0), (100.02, 5.0)), 0.0), (400.0, 1, unit((100.01, 5.0), (100.03, 1.0)), 0.0),
        (400.0, 1, unit((300.0, 1.0)), 0.0), (400.0, 1, unit((100.0, 1.0), (300.049, 1.0)), 0.0),
    ]
    df = blocking.with_blocks(spectra(spark, rows), 20.0, "ppm", 32, ["sid"])
    for most in (50, None):
        got = {(r["s1"], r["s2"]): (r["n_match"], r["distance"]) for r in similarity.pair_scores(df, 0.05, 0, most).collect()}
        assert got[0, 1][0] == 2 and got[0, 1][1] == pytest.approx(1 - 26 / 26)  # the crossing assignment
        assert got[2, 3] == (1, pytest.approx(1 - np.sqrt(0.5)))
        assert (0, 2) not in got  # no shared peak: no row, distance 1
        assert got[0, 3][0] == 1
    gated = {(r["s1"], r["s2"]): r["distance"] for r in similarity.pair_scores(df, 0.05, 2).collect()}
    assert gated[2, 3] == 1.0


def test_clusters_do_not_depend_on_row_order(spark):
    rng = np.random.default_rng(1)
    base = [[(150.0 + 17.3 * j + rng.random(), 1 + 9 * rng.random()) for j in range(40)] for _ in range(4)]
    rows = [(400.0 + 0.001 * (i % 3), None if i % 4 == 0 else 2, [(m + rng.normal() * 0.002, x) for m, x in base[i % 4]], float(i)) for i in range(24)]
    s = Settings(max_peaks_used=30)
    df = preprocess.process_spectra(spectra(spark, rows), s).where("valid")
    one = {r["sid"]: (r["cluster"], r["is_representative"]) for r in pipeline.score_and_cluster(df, s, ["sid"]).collect()}
    two = {r["sid"]: (r["cluster"], r["is_representative"]) for r in pipeline.score_and_cluster(df.repartition(7).orderBy(F.desc("sid")), s, ["sid"]).collect()}
    assert one == two
    assert {i: c for i, (c, _) in one.items()} == {i: i % 4 for i in range(24)}
    labels = pipeline.cluster_spectra(df, s, ["sid"]).collect()
    assert sorted({r["cluster"] for r in labels}) == [0, 1, 2, 3] and sum(r["is_representative"] for r in labels) == 4
    assert clustering.summary(spark.createDataFrame([(r["sid"], r["cluster"]) for r in labels], "sid long, cluster int")).first().asDict() == {"n_spectra": 24, "n_clusters": 4, "n_clustered": 24, "n_single": 0, "n_labels": 4}


def test_natural_order(spark):
    df = spark.createDataFrame([("a1b10",), ("a10",), ("a1b2",), ("a9",), ("a09x",)], "s string")
    assert [r["s"] for r in df.orderBy(natural_key(F.col("s"))).collect()] == ["a1b2", "a1b10", "a9", "a09x", "a10"]
    got = numbered(df, [natural_key(F.col("s"))], "n", Scratch(spark, "t")).orderBy("n").collect()
    assert [r["s"] for r in got] == ["a1b2", "a1b10", "a9", "a09x", "a10"] and [r["n"] for r in got] == list(range(5))


MGF = """COM=x
BEGIN IONS
TITLE=one
PEPMASS=500.25 1234
CHARGE=2+
RTINSECONDS=12.5
200.0 1.5
100.0 2
END IONS

BEGIN IONS
TITLE=two
PEPMASS=400
300.5 7
END IONS
BEGIN IONS
PEPMASS=400
300.5 7
END IONS
BEGIN IONS
TITLE=no mass
300.5 7
END IONS
trailing text
"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_mgf(spark, tmp_path, end):
    path = tmp_path / "a.mgf"
    path.write_bytes(MGF.replace("\n", end).encode())
    got = read_spectra(spark, [str(path)]).orderBy("identifier").collect()
    assert [r["identifier"] for r in got] == ["one", "two"]
    assert (got[0]["precursor_mz"], got[0]["precursor_charge"], got[0]["retention_time"]) == (500.25, 2, 12.5)
    assert [(p["mz"], p["intensity"]) for p in got[0]["peaks"]] == [(100.0, 2.0), (200.0, 1.5)]
    assert (got[1]["precursor_charge"], got[1]["retention_time"]) == (None, -1.0)
    assert read_spectra(spark, [str(path)], keep_bad=True).where("bad").count() == 2


def test_mgf_round_trip(spark, tmp_path):
    df = spectra(spark, [(500.5, 3, wide(), 7.0), (400.25, None, wide(5), -1.0)])
    writers.write_spectra(df, str(tmp_path / "x.mgf"))
    got = read_spectra(spark, [str(tmp_path / "*.mgf")]).orderBy("identifier").collect()
    assert [(r["identifier"], r["precursor_mz"], r["precursor_charge"], r["retention_time"], len(r["peaks"])) for r in got] == [("s0", 500.5, 3, 7.0, 6), ("s1", 400.25, None, -1.0, 5)]
    with pytest.raises(ValueError):
        writers.write_spectra(df, str(tmp_path / "x.mzML"))


def cv(name, value=""):
    return f'<cvParam cvRef="MS" accession="MS:0" name="{name}" value="{value}"/>'


def array(kind, values, width, packed):
    raw = np.array(values, f"<f{width // 8}").tobytes()
    raw = zlib.compress(raw) if packed else raw
    return f'<binaryDataArray encodedLength="0">{cv(f"{width}-bit float")}{cv("zlib compression" if packed else "no compression")}{cv(kind)}<binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'


def mzml_spectrum(name, level, width=64, packed=True, charge=cv("charge state", 3), scan=cv("scan start time", 1.5)):
    head = cv("ms level", level) if level else ""
    ion = cv("selected ion m/z", 445.5) + charge
    arrays = array("m/z array", [200, 100, 300], width, packed) + array("intensity array", [1, 2, 3], width, packed)
    return f'<spectrum index="0" id="{name}" defaultArrayLength="3">{head}<scanList count="1"><scan>{scan}</scan></scanList><precursorList count="1"><precursor><selectedIonList count="1"><selectedIon>{ion}</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>'


def test_mzml(spark, tmp_path):
    every = [mzml_spectrum("ms1", 1), mzml_spectrum("ms2", 2), mzml_spectrum("ms3", 3, 32, False, cv("possible charge state", 2)), mzml_spectrum("none", None), mzml_spectrum("bare", 2, charge="", scan="")]
    (tmp_path / "a.mzML").write_text(f'<?xml version="1.0"?><mzML><run><spectrumList count="5">{"".join(every)}</spectrumList></run></mzML>')
    got = {r["identifier"]: r for r in read_spectra(spark, [str(tmp_path / "a.mzML")]).collect()}
    assert sorted(got) == ["bare", "ms2", "ms3"]
    assert (got["ms2"]["precursor_charge"], got["ms3"]["precursor_charge"], got["bare"]["precursor_charge"]) == (3, 2, None)
    assert (got["ms2"]["retention_time"], got["bare"]["retention_time"], got["ms2"]["precursor_mz"]) == (1.5, -1.0, 445.5)
    for r in got.values():
        assert [(p["mz"], p["intensity"]) for p in r["peaks"]] == [(100.0, 2.0), (200.0, 1.0), (300.0, 3.0)]


def test_mzxml(spark, tmp_path):
    def peaks(width, packed):
        raw = struct.pack(">6" + ("d" if width == 64 else "f"), 200, 1, 100, 2, 300, 3)
        return f'<peaks precision="{width}" byteOrder="network" contentType="m/z-int" compressionType="{"zlib" if packed else "none"}">{base64.b64encode(zlib.compress(raw) if packed else raw).decode()}</peaks>'

    inner = f'<scan num="2" msLevel="2" retentionTime="PT90S"><precursorMz precursorCharge="2">445.5</precursorMz>{peaks(32, False)}</scan>'
    text = f'<?xml version="1.0"?><mzXML><msRun><scan num="1" msLevel="1" retentionTime="PT1S">{peaks(32, False)}{inner}</scan><scan num="3" msLevel="2"><precursorMz>500</precursorMz>{peaks(64, True)}</scan></msRun></mzXML>'
    (tmp_path / "a.mzXML").write_text(text)
    got = {r["identifier"]: r for r in read_spectra(spark, [str(tmp_path / "a.mzXML")]).collect()}
    assert sorted(got) == ["2", "3"]
    assert (got["2"]["precursor_charge"], got["2"]["retention_time"], got["3"]["precursor_charge"], got["3"]["retention_time"]) == (2, 1.5, None, -1.0)
    for r in got.values():
        assert [(p["mz"], p["intensity"]) for p in r["peaks"]] == [(100.0, 2.0), (200.0, 1.0), (300.0, 3.0)]


def test_unknown_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        read_spectra(spark, [str(tmp_path / "a.txt")])
    with pytest.raises(ValueError):
        read_spectra(spark, [str(tmp_path / "missing.mgf")])
    assert read_spectra(spark, [str(tmp_path / "*.mgf")]).count() == 0


def test_settings(tmp_path):
    assert parse("a.mgf b.mgf out").input_filenames == ("a.mgf", "b.mgf")
    (tmp_path / "c.ini").write_text("[x]\n# no\nfragment_tol = 0.02\nprecursor_tol = [0.5, Da]\noverwrite = true\nlinkage = average\n")
    s = parse(["-c", str(tmp_path / "c.ini"), "a.mgf", "out", "--linkage", "single"])
    assert (s.fragment_tol, s.precursor_tol, s.overwrite, s.linkage) == (0.02, (0.5, "Da"), True, "single")
    assert s["batch_size"] == 32768
    with pytest.raises(KeyError):
        s["nothing"]
    with pytest.raises(ValueError):
        Settings(linkage="ward")


def test_whole_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = [[(150.0 + 31.7 * j, 1 + 9 * rng.random()) for j in range(20)] for _ in range(2)]
    rows = [(500.0, 2, base[i % 2], float(i)) for i in range(4)] + [(700.0, None, base[0], 1.0), (700.0, 2, [(150.0, 1.0)], 1.0)]
    writers.write_spectra(spectra(spark, rows), str(tmp_path / "in.mgf"))
    args = [str(tmp_path / "in.mgf"), str(tmp_path / "out"), "--work_dir", str(tmp_path / "work"), "--export_representatives"]
    assert pipeline.run(spark, parse(args)) == 0
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[0].startswith("# ionweave version") and sum(x.startswith("#") for x in lines) == 20
    table = [x.split(",") for x in lines if not x.startswith("#")]
    assert table[0] == ["filename", "spectrum_id", "precursor_charge", "precursor_mz", "retention_time", "cluster"]
    by = {r[1]: r[5] for r in table[1:]}
    assert list(by) == ["s0", "s1", "s2", "s3", "s4"]
    assert by["s0"] == by["s2"] != by["s1"] == by["s3"] and len(set(by.values())) == 3
    assert read_spectra(spark, [str(tmp_path / "out.mgf")]).count() == 3
    assert pipeline.run(spark, parse(args)) == 1
    assert pipeline.run(spark, parse([*args, "--overwrite"])) == 0


def test_stream(spark, tmp_path):
    """Two micro-batches: each spectrum has a sid of its own, and clusters see both."""
    from ionweave.streaming.ingest import stage_stream, stream_mgf

    (tmp_path / "in").mkdir()
    writers.write_spectra(spectra(spark, [(500.0, 2, wide(), 0.0), (400.0, None, wide(), 0.0), (400.0, None, wide(2), 0.0)]), str(tmp_path / "in/a.mgf"))
    writers.write_spectra(spectra(spark, [(500.0, 2, wide(), 0.0), (500.0, 2, wide(), 0.0)]), str(tmp_path / "in/b.mgf"))
    stage_stream(stream_mgf(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    df = spark.read.parquet(str(tmp_path / "out")).withColumn("peaks", F.arrays_zip("mz", "intensity"))
    got = df.select("sid", "batch").collect()
    assert len(got) == 4 == len({r["sid"] for r in got}) and {r["batch"] for r in got} == {0, 1}
    labels = pipeline.cluster_spectra(df, Settings()).collect()
    assert len(labels) == 4 and len({r["cluster"] for r in labels}) == 2


def test_charges_that_cannot_be(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("".join(f"BEGIN IONS\nTITLE=t{c}\nPEPMASS=400\nCHARGE={c}\n100 1\nEND IONS\n" for c in ("300+", "2+", "x", "3-", "")))
    got = {r["identifier"]: (r["precursor_charge"], r["bad"]) for r in read_spectra(spark, [str(tmp_path / "a.mgf")], keep_bad=True).collect()}
    assert got == {"t300+": (None, True), "t2+": (2, False), "tx": (None, True), "t3-": (-3, False), "t": (None, False)}


def test_parameters_of_a_whole_mgf_file(spark, tmp_path):
    record = lambda t, more="": f"BEGIN IONS\nTITLE={t}\nPEPMASS=400\n{more}100 1\nEND IONS\n"
    (tmp_path / "a.mgf").write_text("# made by x\nCHARGE=3+\nRTINSECONDS=7\n\n" + record("a") + record("b", "CHARGE=2+\n") + "CHARGE=4+\n" + record("c"))
    (tmp_path / "b.mgf").write_text("MASS=Monoisotopic\n" + record("d"))
    got = {r["identifier"]: (r["precursor_charge"], r["retention_time"]) for r in read_spectra(spark, [str(tmp_path / "*.mgf")]).collect()}
    assert got == {"a": (3, 7.0), "b": (2, 7.0), "c": (3, 7.0), "d": (None, -1.0)}


def test_mzml_parameter_groups_and_truncated_files(spark, tmp_path):
    shared = f'<referenceableParamGroupList><referenceableParamGroup id="g">{cv("ms level", 2)}</referenceableParamGroup><referenceableParamGroup id="h">{cv("64-bit float")}{cv("zlib compression")}</referenceableParamGroup></referenceableParamGroupList>'
    ref = lambda i: f'<referenceableParamGroupRef ref="{i}"/>'
    own = mzml_spectrum("own", 2)
    grouped = mzml_spectrum("grouped", None).replace("<scanList", ref("g") + "<scanList", 1).replace(cv("64-bit float") + cv("zlib compression"), ref("h"))
    (tmp_path / "a.mzML").write_text(f"<mzML>{shared}<run><spectrumList>{grouped}{own}{mzml_spectrum('first', 1)}</spectrumList></run></mzML>")
    (tmp_path / "b.mzML").write_text(f"<mzML><run><spectrumList>{mzml_spectrum('whole', 2)}{mzml_spectrum('broken', 2)[:-60]}")
    got = {r["identifier"]: [p["mz"] for p in r["peaks"]] for r in read_spectra(spark, [str(tmp_path / "*.mzML")]).collect()}
    assert got == dict.fromkeys(("own", "grouped", "whole"), [100.0, 200.0, 300.0])


def test_mzxml_of_any_depth(spark, tmp_path):
    text = base64.b64encode(struct.pack(">4f", 100, 1, 200, 2)).decode()
    scan = lambda i, inner: f"""<scan num="{i}"\n msLevel='2' filterLine="a > b"><scanOrigin parentFileID="x" num="77"/><precursorMz\n precursorCharge="2">44{i}.5</precursorMz><peaks precision="32">{text}</peaks>{inner}</scan>"""
    deep = ""
    for i in range(9, 0, -1):
        deep = scan(i, deep)
    (tmp_path / "a.mzXML").write_text(f'<mzXML><msRun>{deep}<scan num="20" msLevel="2"><precursorMz>1</precursorMz><peaks precision="32"/></scan></msRun></mzXML>')
    (tmp_path / "b.mzXML").write_text(f"<mzXML><msRun>{scan(30, '')}" + scan(31, "")[:-20])
    got = {r["identifier"]: r for r in read_spectra(spark, [str(tmp_path / "*.mzXML")], keep_bad=True).collect()}
    assert sorted(got, key=int) == [*map(str, range(1, 10)), "20", "30", "31"] and [k for k in got if got[k]["bad"]] in (["20", "31"], ["31", "20"])
    for i in (1, 5, 9, 30):
        assert (got[str(i)]["precursor_mz"], got[str(i)]["precursor_charge"], len(got[str(i)]["peaks"])) == (pytest.approx(float(f"44{i}.5")), 2, 2)


def test_staging_sees_changed_files(spark, tmp_path):
    from ionweave.sources.readers import file_states

    s = Settings(input_filenames=(str(tmp_path / "*.mgf"),))
    key = lambda: s.staging_key(file_states(spark, s.input_filenames))
    (tmp_path / "a.mgf").write_text("x")
    one = key()
    assert one == key()
    (tmp_path / "a.mgf").write_text("xy")
    two = key()
    (tmp_path / "b.mgf").write_text("x")
    assert len({one, two, key()}) == 3


def test_results_as_parts(spark, tmp_path):
    writers.write_spectra(spectra(spark, [(500.0, 2, wide(), float(i)) for i in range(4)]), str(tmp_path / "in.mgf"))
    args = [str(tmp_path / "in.mgf"), str(tmp_path / "out"), "--export_representatives", "--parts"]
    assert pipeline.run(spark, parse(args)) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv/part-*")).count() == 4
    assert "".join(p.read_text() for p in (tmp_path / "out.mgf").glob("part-*")).count("BEGIN IONS") == 1
    assert (tmp_path / "out.csv/_settings").read_text().startswith("# ionweave version")
    assert pipeline.run(spark, parse(args)) == 1


def test_large_blocks_are_split_into_components(spark, monkeypatch):
    """One block of many spectra with few similar pairs: no row holds the block, and labels are those of the whole block."""
    rng = np.random.default_rng(8)
    n = 3000
    sid = spark.createDataFrame([(7, i, 400.0, 0.0) for i in range(n)], "block_id long, sid long, precursor_mz double, retention_time double")
    every = {(3 * i, 3 * i + 1): 0.05 + 0.01 * (i % 7) for i in range(n // 3)} | {(3 * i + 1, 3 * i + 2): 0.08 for i in range(0, n // 3, 2)}
    for _ in range(60_000):
        a, b = sorted(rng.integers(0, n, 2).tolist())
        if a < b:
            every.setdefault((a, b), 0.5 + rng.random() / 2)
    pairs = spark.createDataFrame([(7, a, b, d) for (a, b), d in every.items()], "block_id long, s1 long, s2 long, distance double")
    for how in ("complete", "average"):
        monkeypatch.setattr(clustering, "MANY_PAIRS", 1_000_000)
        whole = sorted(map(tuple, clustering.cluster_blocks(sid, pairs, how, 0.1).collect()))
        monkeypatch.setattr(clustering, "MANY_PAIRS", 1000)
        assert sorted(map(tuple, clustering.cluster_blocks(sid, pairs, how, 0.1).collect())) == whole
    large = pairs.select("block_id").distinct()
    rows, inside = clustering._by_components(sid.selectExpr("block_id", "sid", "precursor_mz as mz", "retention_time as rt", "-1L as part"), pairs.withColumn("part", F.lit(-1).cast("long")), large, 0.1, Scratch(spark, "t"))
    assert rows.count() == n and rows.groupBy("part").count().agg(F.max("count")).first()[0] == 3
    assert inside.groupBy("part").count().agg(F.max("count")).first()[0] <= 3


def test_threshold_of_one_takes_whole_blocks(spark):
    rows = [(400.0, 1, wide(6), 0.0), (400.001, 1, [(m + 7, x) for m, x in wide(6)], 0.0), (500.0, 1, wide(6), 0.0), (400.0, None, wide(6), 0.0)]
    s = Settings(distance_threshold=1.0)
    df = preprocess.process_spectra(spectra(spark, rows), s).where("valid")
    got = {r["sid"]: r["cluster"] for r in pipeline.score_and_cluster(df, s, ["sid"]).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_pairs_of_dense_spectra_against_brute_force(spark):
    from itertools import combinations

    from ionweave.operators.kernels import assign

    rng = np.random.default_rng(4)
    rows = [(400.0, 1, sorted((200 + 10 * rng.random(), rng.random() + 0.1) for _ in range(12)), 0.0) for _ in range(6)]
    df = blocking.with_blocks(spectra(spark, rows), 20.0, "ppm", 32, ["sid"])
    got = {(r["s1"], r["s2"]): (r["n_match"], r["distance"]) for r in similarity.pair_scores(df, 0.5).collect()}
    for a, b in combinations(range(6), 2):
        (m, x), (n, y) = (np.array(rows[k][2]).T for k in (a, b))
        i, j = np.nonzero(np.abs(m[:, None] - n[None, :]) <= 0.5)
        score, count = assign(i, j, x[i] * y[j])
        assert got[a, b] == (count, pytest.approx(1 - min(1.0, score)))


def test_bin_vectors_and_projection(spark):
    from ionweave.operators import vectors

    df = spectra(spark, [(400.0, 1, [(100.0, 1.0), (100.01, 2.0), (100.06, 4.0)], 0.0), (400.0, 1, [(100.0, 3.0)], 0.0)])
    v = vectors.bin_vectors(df, 100.0, 0.05)
    assert {(r["sid"], r["bin"]): r["value"] for r in v.collect()} == {(0, 0): 3.0, (0, 1): 4.0, (1, 0): 3.0}
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 1, 2.0)], "bin long, dim int, weight double")
    plain = {(r["sid"], r["dim"]): r["value"] for r in vectors.project(v, t, norm=False).collect()}
    assert plain == {(0, 0): 3.0, (0, 1): 5.0, (1, 0): 3.0, (1, 1): -3.0}
    assert sum(r["value"] ** 2 for r in vectors.project(v, t).where("sid = 0").collect()) == pytest.approx(1)
