import pytest
from pyspark.sql import functions as F

from kinweave.functions import columns as K
from kinweave.operators import shared
from kinweave.operators.shared import one_person, shared_identifiers
from kinweave.plans.review import Review, pressed
from kinweave.functions.names import NameKey, name_key
from kinweave.schema import ADDRESS
from kinweave.sources.book import fingerprint, files_frame, read_book


def csv(*names):
    return "First Name,Last Name,Mobile Phone\n" + "".join(f"{n},Lund,12345{i}\n" for i, n in enumerate(names))


def test_ids_are_dense_whatever_the_paths(spark, tmp_path):
    for folder in ("a", "b c", "d"):
        (tmp_path / folder).mkdir()
    (tmp_path / "a" / "c.csv").write_text(csv("Ada", "Bob"))
    (tmp_path / "b c" / "c.csv").write_text(csv("Cyd"))
    (tmp_path / "b c" / "my [1] c.csv").write_text(csv("Dan"))
    (tmp_path / "d" / "z%20,1.csv").write_text(csv("Eve"))
    (tmp_path / "d" / "_hidden").write_text(csv("Fay"))
    (tmp_path / "a" / "again.csv").write_text(csv("Ada", "Bob"))
    given = lambda paths: [(r["id"], r["name"]["given"]) for r in read_book(spark, [str(tmp_path / p) for p in paths]).contacts.orderBy("id").collect()]
    assert given(["b c/c.csv", "a/c.csv"]) == [(0, "Cyd"), (1, "Ada"), (2, "Bob")]
    assert given(["a/c.csv", "b c/c.csv", "b c/my [1] c.csv"]) == [(0, "Ada"), (1, "Bob"), (2, "Cyd"), (3, "Dan")]
    assert given(["d", "b c"]) == [(0, "Eve"), (1, "Cyd"), (2, "Dan")]
    assert given(["a/c.csv", "a/again.csv", "*/c.csv"]) == [(0, "Ada"), (1, "Bob"), (2, "Cyd")]
    with pytest.raises(FileNotFoundError):
        given(["a/c.csv", "none.csv"])
    files = [(r["file"], r["n"]) for r in read_book(spark, [str(tmp_path / "b c"), str(tmp_path / "a")]).files.collect()]
    assert files == [("c.csv", 1), ("my [1] c.csv", 1), ("again.csv", 2)]
    one, two = (fingerprint(files_frame(spark, [str(tmp_path / p) for p in paths])) for paths in (["a", "d"], ["d", "a"]))
    assert one != two


def test_never_over_an_input(spark, tmp_path):
    from kinweave.sinks.vcard import write_vcards

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(csv("Ada"))
    book = read_book(spark, [str(tmp_path / "in" / "a.csv")]).contacts
    for path in ("in/a.csv", "in"):
        with pytest.raises(ValueError, match="was read"):
            write_vcards(book, str(tmp_path / path), inputs=[str(tmp_path / "in" / "a.csv")])
    write_vcards(book, str(tmp_path / "in" / "out"), inputs=[str(tmp_path / "in" / "a.csv")])
    assert (tmp_path / "in" / "a.csv").read_text() == csv("Ada") and (tmp_path / "in" / "out").is_dir()


def test_review_is_saved_for_its_files_and_keys_work():
    r = Review((((0, 1, 2), "sure"), ((3, 4), "likely")))
    r = pressed(pressed(r, "2"), "m")
    assert r.members(0) == [0, 2] and r.counts() == {"merge": 1, "apart": 0, "open": 1} and r.at == 1
    saved = r.dump("abc")
    assert Review(r.groups).load(saved, "abc").counts()["merge"] == 1 and Review(r.groups).load(saved, "xyz").counts()["merge"] == 0
    assert pressed(r, "z", control=True).counts()["merge"] == 0 and pressed(r, "n").counts()["apart"] == 1 and pressed(r, "m", alt=True) == r and pressed(r, "9") == r
    assert pressed(r, "k").at == 0 and pressed(r, "q") == r and pressed(pressed(r, "u"), "A").counts()["merge"] == 1


def test_lines_for_people(spark):
    row = spark.createDataFrame([(("1", "", "Main St", "Pune", "MH", "411", "India"), "Chef", "Acme", "Sales", "--03-07", "1984-03-07")], f"a {ADDRESS}, title string, org string, department string, d string, e string")
    got = row.select(K.address_line(F.col("a")), K.work_line(F.col("title"), F.col("org"), F.col("department")), K.birthday_text(F.col("d")), K.birthday_text(F.col("e"))).first()
    assert tuple(got) == ("1, Main St, Pune MH 411, India", "Chef, Acme, Sales", "7 March, no year", "1984-03-07")


PREPARED = "id long, name struct<kind:string,given:string,family:string,org:string>, phones array<struct<key:string,display:string>>, emails array<string>"


@pytest.mark.parametrize("small", [500, 1])
def test_shared_identifiers_of_few_and_many_names(spark, monkeypatch, small):
    monkeypatch.setattr(shared, "SMALL", small)
    people = {"p1": ["Robert Hale", "Bob Hale", "R. Hale"], "p2": ["Eva Ruiz", "Paul Ruiz", "Eva Ruiz"], "p3": ["Ann Lee", "A. Lee", "Amy Lee", "Amy Lee"], "p4": ["Ann Lee"], "p5": ["Berg,", "Berg,"], "p6": ["A. Lee", "Ann Lee", "Anna Lund", "A. Lund"]}
    rows, n = [], 0
    for phone, names in people.items():
        for name in names:
            rows.append((n, tuple(name_key("", "", name, "")), [(phone, phone.upper())], []))
            n += 1
    got = {r["key"]: r["contacts"] for r in shared_identifiers(spark.createDataFrame(rows, PREPARED)).collect()}
    want = {}
    for phone, names in people.items():
        keys = [NameKey(*name_key("", "", x, "")) for x in names]
        if len(keys) > 1 and not one_person(keys):
            want[phone] = [i for i, r in enumerate(rows) if r[2][0][0] == phone]
    assert got == want and "p2" in want and "p1" not in want and "p5" in want


def test_a_number_held_by_very_many_names(spark):
    key = F.struct(F.lit("person").alias("kind"), F.concat(F.lit("g"), F.conv("id", 10, 26)).alias("given"), F.concat(F.lit("f"), F.conv(F.col("id") * 7919 + 11, 10, 26)).alias("family"), F.lit("").alias("org"))
    phone = F.array(F.struct(F.lit("p").alias("key"), F.lit("P").alias("display")))
    rows = spark.range(20_000).select("id", key.alias("name"), phone.alias("phones"), F.array().cast("array<string>").alias("emails"))
    got = shared_identifiers(rows).collect()
    assert [r["key"] for r in got] == ["p"] and len(got[0]["contacts"]) == 20_000


def test_temporary_tables_are_removed(spark, tmp_path):
    from pathlib import Path

    from kinweave.operators.checkpoints import checkpoint, own_dir, temporary

    kept = checkpoint(spark.range(3))
    with temporary(spark):
        made = checkpoint(spark.range(5))
        folder = Path(own_dir(spark, "x").removeprefix("file://"))
        folder.mkdir()
        path = Path(made.inputFiles()[0].removeprefix("file://")).parent
        assert path.exists() and made.count() == 5
    assert not path.exists() and not folder.exists() and kept.count() == 3
