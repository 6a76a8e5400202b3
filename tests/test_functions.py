import hashlib

import pytest
from pyspark.sql import functions as F

from revquarry.functions import objects as O


def value(spark, column, **inputs):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items()), F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


def test_object_id_is_the_known_hash(spark):
    assert value(spark, O.object_id("blob", "t"), t="foo") == "19102815663d23f8b75a47e7a01965dcdc96468c"
    assert value(spark, O.object_id("blob", "t"), t="é") == hashlib.sha1(b"blob 2\0\xc3\xa9").hexdigest()


def test_text_and_binary(spark):
    assert value(spark, O.is_text("t"), t=bytearray(b"This is a text blob."))
    assert not value(spark, O.is_text("t"), t=bytearray(b"\xff\xfe\xfd\x00"))
    assert value(spark, O.is_text("t"), t=bytearray(b"a" * 8000 + b"\0"))


def test_signature(spark):
    s = value(spark, O.signature("t"), t="Ada Weaver <ada@loom.example> 1714565109 -0130")
    assert (s["name"], s["email"], s["epoch"], s["tz_min"]) == ("Ada Weaver", "ada@loom.example", 1714565109, -90)
    assert value(spark, O.signature(F.lit(None).cast("string"))) is None
    assert value(spark, O.signature("t", strict=False), t="no signature at all") is None


@pytest.mark.parametrize(("text", "said"), [("no signature at all", "Invalid git signature format."), ("Ada <a@l> 1714565109 0130", "Invalid time zone offset format.")])
def test_bad_signatures(spark, text, said):
    with pytest.raises(Exception, match=said):
        value(spark, O.signature("t"), t=text)


COMMIT = "tree c0ffee1234c0ffee\nparent feedbead5678feed\nauthor Ada Weaver <ada@loom.example> 1714565109 -0130\ncommitter Cy Dyer <cy@vat.example> 1714565200 +0545\n\nWarp the loom"


def test_commit(spark):
    c = value(spark, O.commit("t"), t=COMMIT)
    assert (c["tree"], c["parents"], c["message"], c["committer"]["name"]) == ("c0ffee1234c0ffee", ["feedbead5678feed"], "Warp the loom", "Cy Dyer")
    assert value(spark, O.commit("t"), t=COMMIT.replace("\n\nWarp", "\n\n\n\nWarp") + "\n\n")["message"] == "Warp the loom\n"
    with pytest.raises(Exception, match="missing tree"):
        value(spark, O.commit("t"), t=COMMIT.partition("\n")[2])


TAG = "object c0ffee1234c0ffee\ntype commit\ntag r7\ntagger Ada Weaver <ada@loom.example> 1714565109 -0130\n\nFirst cloth"


def test_tag(spark):
    t = value(spark, O.tag("t"), t=TAG)
    assert (t["target_type"], t["tag"], t["message"], t["tagger"]["tz_min"]) == ("commit", "r7", "First cloth", -90)
    for k, name in enumerate(("object", "type", "tag")):
        lines = TAG.split("\n")
        with pytest.raises(Exception, match=f"missing {name}"):
            value(spark, O.tag("t"), t="\n".join(lines[:k] + lines[k + 1 :]))


def test_lfs_pointer(spark):
    p = value(spark, O.lfs_pointer("t"), t=f"{O.LFS_PREFIX}\noid sha256:{'ab' * 32}\nsize 12\n")
    assert (p["sha256"], p["size"]) == ("ab" * 32, 12)
    assert value(spark, O.lfs_pointer("t"), t="plain") is None
    with pytest.raises(Exception, match="Invalid LFS pointer"):
        value(spark, O.lfs_pointer("t"), t=O.LFS_PREFIX + "\nnothing")


def test_paths(spark):
    assert value(spark, O.chunks("t"), t="/a//b/") == ["a", "b"]
    assert [value(spark, O.contains_path(F.lit(p), F.lit(q))) for p, q in (("a", "a/b"), ("a", "ab"), ("", "x"), ("a/b", "a"))] == [True, False, True, False]
    assert value(spark, O.relative_path(F.lit("repository"), F.lit("repository/cellar/jars/jam.txt"))) == "cellar/jars/jam.txt"
    assert value(spark, O.relative_path(F.lit("c:\\r"), F.lit("c:\\r\\A\\f"))) == "A/f"
    rows = spark.createDataFrame([("a-c",), ("a/b",), ("a",)], "p string").orderBy(O.chunks("p")).collect()
    assert [r.p for r in rows] == ["a", "a/b", "a-c"]


def test_names_modes_hashes(spark):
    assert value(spark, O.friendly_name("t"), t="refs/remotes/origin/x") == "origin/x"
    with pytest.raises(Exception, match="Not a branch"):
        value(spark, O.friendly_name("t"), t="refs/tags/x")
    assert value(spark, O.mode_octal(O.mode_number("t")), t="100755") == "100755"
    assert value(spark, O.mode_kind("t"), t="160000") == "gitlink"
    assert value(spark, O.is_hash("t"), t="A" * 40) and not value(spark, O.is_hash("t"), t="a" * 41)


def test_lines_and_hash(spark):
    assert value(spark, O.line_set("t"), t="a\r\nb\na\n") == ["a", "b"]
    assert value(spark, O.line_set("t"), t="a\n\nb") == ["a", "", "b"]
    assert value(spark, O.line_set("t"), t="") == []
    assert value(spark, O.fnv1a("t"), t="a") == 3826002220
    assert value(spark, O.fnv1a("t"), t="") == 2166136261


def test_texts(spark):
    assert value(spark, O.preview("t"), t="x" * 51) == "x" * 50 + "..."
    assert value(spark, O.preview("t"), t="a\nb") == "ab"
    assert value(spark, O.change_text(F.lit("Added"), F.lit(None).cast("string"), F.lit("n"))) == "Added: null -> n"
