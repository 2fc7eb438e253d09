"""Small fixtures and sequential models used as judges."""

import math

SUFFIX_LINES = """
// subset written by hand
com
net
org
eu
de
jp
biz
ac
cn
in
co.in
ac.in
uk
co.uk
uk.com
au
com.au
ls
co.ls
cy
com.cy
at
ac.at
io
github.io
dev
pages.dev
duckdns.org
dyndns.org
hopto.org
*.ck
!www.ck

*.kobe.jp
!city.kobe.jp
公司.cn
""".split("\n")


def event(seq, ts, ip="10.0.0.1", domain="a.example.com", qtype="A", length=20.0, nx=False):
    return (seq, float(ts), ip, domain, qtype, float(length), nx, int(ts * 1_000_000))


def model_windows(rows, bucket_us=5_000_000, n_buckets=12):
    """Features after each event, one event at a time."""
    seen, out = {}, {}
    for seq, _, ip, domain, qtype, length, nx, ts_us in sorted(rows):
        b = ts_us // bucket_us
        past = seen.setdefault(ip, [])
        past.append((b, domain, qtype, length, nx))
        live = [p for p in past if b - n_buckets < p[0] <= b]
        n = len(live)
        types = {}
        for p in live:
            types[p[2]] = types.get(p[2], 0) + 1
        out[seq] = dict(
            query_rate=n, unique_subdomains=float(len({p[1] for p in live})),
            avg_query_len=sum(p[3] for p in live) / n, txt_ratio=types.get("TXT", 0) / n,
            nxdomain_rate=sum(p[4] for p in live) / n, non_a_ratio=(n - types.get("A", 0)) / n,
            record_type_entropy=-sum(c / n * math.log2(c / n) for c in types.values()))
    return out
