"""The rendered Markdown report against a brute-force renderer of the same
format, on a fixture with multi-line messages, ties and empty fields."""
import glob
import os
import re
from datetime import datetime
from zoneinfo import ZoneInfo

from helpers import boost, invoices
from satledger.plans import render
from satledger.session import scratch_path

NO_MSG = "No Message Found :("


def java_split_lines(s):
    if s == "":
        return [""]
    parts = re.split(r"\r?\n", s)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def date(cd):
    return datetime.fromtimestamp(cd, ZoneInfo("America/Los_Angeles")).strftime(
        "%Y/%m/%d %-I:%M:%S %p %Z")


def comma(n):
    return f"{(n or 0):,}"


def brute_force(rows, pattern, since, excluded):
    def ok(r):
        ep = r["episode"] if r["episode"] is not None else "Unknown Episode"
        return (r["creation_date"] > since and r.get("snn") not in excluded and r["podcast"] is not None
                and (re.fullmatch(pattern, r["podcast"]) or re.fullmatch(pattern, ep)))
    for r in rows:
        s = r["sender_name"]
        r["snn"] = None if s is None else re.sub("^@", "", s.strip().lower())
        r["sats"] = None if r["value_msat_total"] is None else r["value_msat_total"] // 1000
    valid = [r for r in rows if ok(r)]
    bcd = [r["creation_date"] for r in valid if r["action"] == "boost"]
    win, last = [], ""
    if bcd:
        cutoff = max(bcd)
        last = str(cutoff)
        win = [r for r in valid if r["creation_date"] <= cutoff]
    counted = [r for r in win if r["snn"] is not None and r["sats"] is not None]
    senders = {}
    for r in counted:
        if r["action"] == "boost":
            senders.setdefault(r["snn"], []).append(r)

    def quote(m):
        return "\n".join("> " + x for x in java_split_lines(m if m is not None else NO_MSG))

    def batch(s, bs):
        bs = sorted(bs, key=lambda r: (r["creation_date"], r["source"], r["identifier"]))
        f = bs[0]
        first = (f"+ {f['podcast'] or ''}\n+ {f['episode'] or ''}\n+ {f['app_name'] or ''}\n"
                 f"+ {f['source']}\n\n+ {date(f['creation_date'])} ({f['creation_date']})\n"
                 f"+ {comma(f['sats'])} sats\n" + quote(f["message"]))
        later = [f"\n+ {date(r['creation_date'])} ({r['creation_date']})\n+ {comma(r['sats'])} sats\n"
                 + quote(r["message"]) for r in bs[1:]]
        total = sum(r["sats"] for r in bs)
        return (f"### From: {s}\n+ {comma(total)} sats\n+ {comma(len(bs))} boosts\n"
                + "\n".join([first] + later) + "\n")

    tot = {s: sum(r["sats"] for r in bs) for s, bs in senders.items()}
    first = {s: min(r["creation_date"] for r in bs) for s, bs in senders.items()}
    ballers = sorted([s for s in senders if tot[s] >= 20000], key=lambda s: (-tot[s], s))
    mids = sorted([s for s in senders if 2000 <= tot[s] < 20000], key=lambda s: (first[s], s))
    thanks = sorted([s for s in senders if tot[s] < 2000], key=lambda s: (first[s], s))

    def section(ss):
        return "\n".join(batch(s, senders[s]) for s in ss)

    def summ(action):
        rs = [r for r in counted if action is None or r["action"] == action]
        return comma(sum(r["sats"] for r in rs)), comma(len(rs)), comma(len({r["snn"] for r in rs}))
    b, st, t = summ("boost"), summ("stream"), summ(None)
    return ("## Baller Boosts\n" + section(ballers) + "\n" + "## Boosts\n" + section(mids) + "\n"
            + "## Thanks\n" + section(thanks)
            + f"\n## Boost Summary\n+ Total Boosted Sats: {b[0]}\n+ Total Boosts: {b[1]}\n+ Total Boosters: {b[2]}\n"
            + f"\n## Stream Summary\n+ Total Streamed Sats: {st[0]}\n+ Total Streams: {st[1]}\n+ Total Streamers: {st[2]}\n"
            + f"\n## Summary\n+ Total Sats: {t[0]}\n+ Total Invoices: {t[1]}\n+ Total Unique Senders: {t[2]}\n"
            + f"\n## Last Seen\n+ Last seen ID: {last}\n")


def written(spark, lines):
    path = scratch_path(spark, "report")
    render.write_report(lines, path)
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    return "".join(open(p).read() for p in parts)


ROWS = [
    boost(1, 1725148800, " @Alice", 25, message="line one\nline two\n\n"),
    boost(2, 1725148900, "@alice", 30000, message=None, episode=None),
    boost(3, 1725148900, "bob", 1500, message="hi\r\nthere", app=None),
    boost(4, 1704067200, "carol", 2500, message=""),
    boost(5, 1704067300, "carol", 100, message="\n"),
    boost(6, 1725149000, "dave", 7, action="stream"),
    boost(7, 1725149999, "erin", 50, action="stream"),          # after the cutoff
    boost(8, 1704067250, "frank", 20000, source="wallet"),
    boost(9, 1704067250, "gina", 20000, source="node_b"),        # ties with frank
    boost(10, 1725148950, None, 99),                              # sets nothing but cutoff
]


def test_report_document_matches_brute_force(spark):
    inv = invoices(spark, [dict(r) for r in ROWS])
    for since in (0, 1704067260, 1800000000):
        doc = written(spark, render.report_lines(inv, ".*", since, ["nobody"]))
        assert doc == brute_force([dict(r) for r in ROWS], ".*", since, {"nobody"})


def test_flat_blocks(spark):
    inv = invoices(spark, [dict(ROWS[0])])
    block = render.boost_blocks(inv).first().block
    assert block == ("### From: alice\n + 25 sats\n + Alpha Unplugged / Episode 1\n"
                     " + app_1 Sun Sep 01 00:00:00 UTC 2024 (1725148800)\n + node_a\n"
                     "   > line one\n   > line two\n")


def test_boosts_by_event_time_to_file(spark):
    times = [1725148800, 1704067300, 1704067200, 1704067200, 1725148799]
    rows = [{**ROWS[0], "identifier": f"t{k}", "creation_date": t} for k, t in enumerate(times)]
    inv = invoices(spark, rows).repartition(3)
    path = scratch_path(spark, "boosts")
    render.write_boosts(inv, path)
    doc = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(path, "part-*"))))
    blocks = {r.identifier: r.block + "\n" for r in render.boost_blocks(inv).collect()}
    assert doc == "".join(blocks[k] for k in ("t2", "t3", "t1", "t4", "t0"))
