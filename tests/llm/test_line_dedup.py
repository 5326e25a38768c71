import collections
import hashlib
import re

from credlens.llm import line_dedup

LINE = "this line is shared by many documents"


def brute(rows, min_docs=3):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or (i is not None and keeper[key(x)] == i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(table, odd):
    rows = odd + [(10 + i, f"head {i}\n  {LINE.upper()} \t\n\ntail {i}") for i in range(6)] + [
        (20, LINE), (20, LINE), (None, LINE + "\nmine"), (21, "a line of nineteen c"[:19] + "\nx"),
        (22, "a line of nineteen c"[:19]), (23, "a line of nineteen c"[:19]), (24, "two docs only hold this line"),
        (25, "two docs only hold this line"), (26, "\n\n"), (27, "é漢🎉 and some more letters here\n" * 3),
        (28, "é漢🎉 and some more letters here"), (29, "É漢🎉 AND SOME MORE LETTERS HERE"),
        (30, "é漢🎉 and some more letters here  ")]
    got = line_dedup.line_digests(table(rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == brute(rows)
    dropped = {r.doc_id: r.n_dropped for r in got}
    assert dropped[20] == 0 and dropped[15] == 1 and dropped[10] == 1 and dropped[None] >= 1 and dropped[24] == 0
    assert dropped[28] == 1 and dropped[30] == 0 and dropped[29] == 0  # only A-Z are folded, so É differs


def test_keeps_the_other_lines_in_order(table):
    rows = [(i, f"first {i}\n{LINE}\nlast {i}") for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows)).collect()}
    assert got[3] == f"first 3\n{LINE}\nlast 3" and got[0] == "first 0\nlast 0"


def test_empty_table(table):
    assert line_dedup.line_digests(table([])).count() == 0
