from collections import Counter

from dnsflow.queries import catalog


def test_ranks_without_one_task(spark, capsys):
    names = [f"h{i % 37}.com" for i in range(500)] + [f"h{i % 5}.com" for i in range(40)]
    ranks = catalog._ranks(spark.createDataFrame([(n,) for n in names], "domain string").repartition(4))
    order = sorted(Counter(names).items(), key=lambda x: (-x[1], x[0]))
    assert sorted(map(tuple, ranks.collect())) == [(i + 1, n) for i, (n, _) in enumerate(order)]
    ranks.explain()
    plan = capsys.readouterr().out
    assert "windowspecdefinition(_less" not in plan and plan.count("windowspecdefinition(_block") > 0
