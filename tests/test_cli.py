"""The command line over a small folder of sources and catalogs."""

import json
import os

from locflow.cli import main
from locflow.sources import xliff
from test_xliff import CATALOG


def _setup(tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(os.path.join(src, "a"))
    with open(os.path.join(src, "a", "one.cs"), "w") as f:
        f.write('class A { string s = "Hello world"; string t = "utf-8"; }\n')
    with open(os.path.join(src, "bad.cs"), "w") as f:
        f.write('var z = "open\n')
    cats = os.path.join(tmp_dir, "cats")
    os.makedirs(cats)
    with open(os.path.join(cats, "app.en-US.xlf"), "w") as f:
        f.write(CATALOG.replace('target-language="cs-CZ"', 'target-language="en-US"'))
    keys = os.path.join(tmp_dir, "keys")
    os.makedirs(keys)
    with open(os.path.join(keys, "XlfKeys.cs"), "w") as f:
        f.write('class XlfKeys {\n    public const string Bye = "Bye";\n}\n')
    return src, cats, os.path.join(keys, "XlfKeys.cs")


def _json_rows(folder):
    rows = []
    for p in sorted(os.listdir(folder)):
        if p.startswith("part-"):
            rows += [json.loads(l) for l in open(os.path.join(folder, p)) if l.strip()]
    return rows


def test_cli_split_translate_constants(spark, tmp_dir):
    src, cats, keys = _setup(tmp_dir)
    out = os.path.join(tmp_dir, "out")
    main(["split", src, out], spark=spark)
    rep = {r["stem"]: r for r in _json_rows(os.path.join(out, "report"))}
    assert rep["one"]["to_translate"] == "Hello world" and rep["bad"]["status"] == "unbalanced"

    main(["translate", src, cats, out, "--lang", "en"], spark=spark)
    srcs = spark.read.parquet(os.path.join(out, "sources")).collect()
    assert [r.content for r in srcs] == ['class A { string s = sess.i18n(XlfKeys.HelloWorld); string t = "utf-8"; }\n']
    back, _ = xliff.read_catalogs(spark, os.path.join(out, "catalog"), glob="part-*", lang_from="attribute")
    assert sorted((r.lang, r.key, r.target) for r in back.collect()) == [
        ("en", "Bye", "Nashle"), ("en", "Hello", " Ahoj "), ("en", "HelloWorld", "Hello world")]

    main(["missing-constants", cats, keys, out], spark=spark)
    folder = os.path.join(out, "constants")
    sub = [d for d in os.listdir(folder) if d.startswith("path=")][0]
    lines = [l for p in sorted(os.listdir(os.path.join(folder, sub))) if p.startswith("part-")
             for l in open(os.path.join(folder, sub, p)).read().splitlines()]
    assert lines == ["class XlfKeys {", 'public const string Hello = "Hello";', '    public const string Bye = "Bye";', "}", ""]

    main(["clean-lines", src, out], spark=spark)
    assert len(_json_rows(os.path.join(out, "lines"))) == 2
    main(["migrate-constants", os.path.dirname(keys), out], spark=spark)
    mig = spark.read.parquet(os.path.join(out, "sources")).collect()[0].content
    assert "public static string Bye { get { return sess.i18n(XlfKeys.Bye); } }" in mig
    back, _ = xliff.read_catalogs(spark, os.path.join(out, "catalog"), glob="part-*", lang_from="attribute")
    assert [(r.lang, r.key, r.target) for r in back.collect()] == [("en", "Bye", "Bye")]


def test_cli_translate_keeps_all_languages(spark, tmp_dir):
    src, cats, _ = _setup(tmp_dir)
    for tag in ("cs-CZ", "de-DE"):
        with open(os.path.join(cats, f"app.{tag}.xlf"), "w") as f:
            f.write(CATALOG.replace('target-language="cs-CZ"', f'target-language="{tag}"'))
    out = os.path.join(tmp_dir, "out")
    main(["translate", src, cats, out, "--lang", "de"], spark=spark)
    back, _ = xliff.read_catalogs(spark, os.path.join(out, "catalog"), tags=("cs", "de", "en"), glob="part-*", lang_from="attribute")
    rows = sorted((r.lang, r.key) for r in back.collect())
    assert rows == [("cs", "Bye"), ("cs", "Hello"), ("de", "Bye"), ("de", "Hello"), ("de", "HelloWorld"), ("en", "Bye"), ("en", "Hello")]


def test_cli_add_texts(spark, tmp_dir):
    _, cats, keys = _setup(tmp_dir)
    texts = os.path.join(tmp_dir, "texts.txt")
    with open(texts, "w") as f:
        f.write("New entry\n\nBye\nNew entry\n")
    out = os.path.join(tmp_dir, "out")
    main(["add-texts", texts, cats, keys, out, "--lang", "en"], spark=spark)
    back, _ = xliff.read_catalogs(spark, os.path.join(out, "catalog"), glob="part-*", lang_from="attribute")
    assert sorted((r.lang, r.key, r.target) for r in back.collect()) == [
        ("en", "Bye", "Nashle"), ("en", "Hello", " Ahoj "), ("en", "NewEntry", "New entry")]
    folder = os.path.join(out, "constants")
    sub = [d for d in os.listdir(folder) if d.startswith("path=")][0]
    lines = [l for p in sorted(os.listdir(os.path.join(folder, sub))) if p.startswith("part-")
             for l in open(os.path.join(folder, sub, p)).read().splitlines()]
    assert lines[1] == 'public const string NewEntry = "NewEntry";' and sum("Bye" in l for l in lines) == 1


def test_cli_keeps_languages_nobody_named_and_names_rejects(spark, tmp_dir):
    src, cats, keys = _setup(tmp_dir)
    for tag in ("cs-CZ", "de-DE", "pt-BR"):
        with open(os.path.join(cats, f"app.{tag}.xlf"), "w") as f:
            f.write(CATALOG.replace('target-language="cs-CZ"', f'target-language="{tag}"'))
    with open(os.path.join(cats, "untagged.xlf"), "w") as f:
        f.write(CATALOG)
    texts = os.path.join(tmp_dir, "texts.txt")
    with open(texts, "w") as f:
        f.write("New entry\n")
    for k, args in enumerate((["translate", src, cats], ["add-texts", texts, cats, keys], ["migrate-constants", os.path.dirname(keys)])):
        out = os.path.join(tmp_dir, f"out{k}")
        main([*args, out] + (["--catalogs", cats] if args[0] == "migrate-constants" else ["--lang", "en"]), spark=spark)
        back, _ = xliff.read_catalogs(spark, os.path.join(out, "catalog"), tags=None, glob="part-*", lang_from="attribute")
        assert {r.lang for r in back.collect()} == {"cs", "de", "en", "pt"}, args[0]
        assert any(r["stage"] == "catalog_name" and "untagged" in r["path"] for r in _json_rows(os.path.join(out, "rejects"))), args[0]
    assert open(os.path.join(tmp_dir, "out0", "files", "a", "one.cs")).read() == (
        'class A { string s = sess.i18n(XlfKeys.HelloWorld); string t = "utf-8"; }\n')
    out = os.path.join(tmp_dir, "out9")
    main(["missing-constants", cats, keys, out, "--tags", "en,cs"], spark=spark)
    assert {r["detail"][-2:] for r in _json_rows(os.path.join(out, "rejects")) if r["stage"] == "catalog_name"} == {"de", "pt", ": "}
