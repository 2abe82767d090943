"""Address predicates work an address out once."""

from pyspark.sql import functions as F

from sentrylake.functions.predicates import m

WANT = {"10.0.0.1": True, "::ffff:10.9.8.7": True, "::FFFF:0a01:0203": True, "0:0:0:0:0:ffff:10.0.0.2": True, "::ffff:11.0.0.1": False, "::10.0.0.1": True, "10.0.0.01": False, "::ffff:10.0.0.1%1": False, "1::2": True, "2::": False, "": False, "1:2:3:4:5:6:7::": True, "1:2:3:4:5:6:7:8::": False, "::1.2.3.4.5": False}


def test_blocks_do_not_multiply_an_address(spark):
    """A block of IPv6 held 270 parses of the address."""
    ip = F.concat(F.col("ip"), F.lit(""))
    hit = m(ip).cidr("10.0.0.0/8", "1::/16", "::a00:0/104")
    assert hit._jc.toString().count("regexp_extract") == 1
    df = spark.createDataFrame([*((k,) for k in WANT), (None,)], "ip string").select("ip", hit.alias("hit"))
    assert {r.ip: r.hit for r in df.collect()} == WANT | {None: False}
