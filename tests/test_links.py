"""Markdown directory source and link extraction."""
import glob
import os

from satledger.operators.links import episode_links, render_listing
from satledger.session import scratch_path
from satledger.sources.markdown import read_markdown_dir


def test_links_from_markdown_dir(spark):
    d = scratch_path(spark, "md")
    os.makedirs(d)
    with open(os.path.join(d, "ep-007.md"), "w") as f:
        f.write('See [one](http://a.example/1 "title") and [two](/b).\nAlso [3](c)\n')
    with open(os.path.join(d, "ep-12.md"), "w") as f:
        f.write("no links here [x] (y)")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("[skip](me)")
    links = render_listing(episode_links(read_markdown_dir(spark, d)))
    got = [(r.file_name, r.episode, r.pos, r.text, r.link, r.line)
           for r in links.orderBy("file_name", "pos").collect()]
    assert got == [
        ("ep-007.md", 7, 0, "one", "http://a.example/1", "+ [ one ]( http://a.example/1 )"),
        ("ep-007.md", 7, 1, "two", "/b", "+ [ two ]( /b )"),
        ("ep-007.md", 7, 2, "3", "c", "+ [ 3 ]( c )"),
    ]


def test_listing_lines(spark):
    from satledger.operators.links import listing_lines

    d = scratch_path(spark, "md")
    os.makedirs(d)
    with open(os.path.join(d, "b-12.md"), "w") as f:
        f.write("[x](y)")
    with open(os.path.join(d, "a-007.md"), "w") as f:
        f.write("none")
    lines = [r.line for r in listing_lines(read_markdown_dir(spark, d)).orderBy("file_name", "pos").collect()]
    assert "\n".join(lines) + "\n" == "##  7\n\n##  12\n+ [ x ]( y )\n\n"


def test_listing_to_file_in_name_order(spark):
    from satledger.operators.links import write_listing

    docs = spark.createDataFrame([(f"{c}-{n}.md", f"[{c}](x) [two](y)") for n, c in enumerate("dbeac")], "file_name string, text string")
    path = scratch_path(spark, "listing")
    write_listing(docs.repartition(3), path)
    doc = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(path, "part-*"))))
    assert doc == "".join(f"##  {n}\n+ [ {c} ]( x )\n+ [ two ]( y )\n\n" for c, n in sorted((c, n) for n, c in enumerate("dbeac")))


def test_markdown_directory_by_name(spark):
    """Whole files with their place in name order; names as they are, other files left out."""
    from satledger.session import scratch_path
    from satledger.sources.markdown import ranked_markdown_dir, write_markdown_dir

    path = scratch_path(spark, "md")
    rows = [("b+c 1%.md", "one\ntwo"), ("a.md", ""), ("b.md", "[t](l)"), ("c.txt", "no")]
    write_markdown_dir(spark.createDataFrame(rows, "file_name string, text string"), path)
    found = ranked_markdown_dir(spark, path).orderBy("rank").collect()
    assert [(r["file_name"], r["text"], r["rank"]) for r in found] == [("a.md", "\n", 1), ("b+c 1%.md", "one\ntwo\n", 2), ("b.md", "[t](l)\n", 3)]
