import ipaddress
import math
import os
import random
import re
from collections import Counter
from urllib.parse import unquote_plus

from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.functions import jsontext, network, text
from alertloom.operators.suffixes import with_domain_parts
from alertloom.sources.refdata import suffix_rules


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def decode(s):
    for _ in range(10):
        t = unquote_plus(s)
        if t == s:
            break
        s = t
    return s.lower()


def test_url_decoding_is_repeated_and_keeps_malformed_parts(spark):
    values = ["a%2527+or+1%253D1", "100%zz", "%", "%%%", "a+b", "plain", "", "%C3%A9", "%ff%fe",
              "%25252525252525252525252541", "A%2", "é%2B+", "%E4%B8%AD%zz%41"]
    assert apply(spark, values, text.url_decoded) == [decode(v) for v in values]
    assert apply(spark, values, text.url_decoded)[:2] == ["a' or 1=1", "100%zz"]


def test_entropy(spark):
    def brute(s):
        s = "".join(c for c in s if c.isalnum())
        n = len(s)
        return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0

    values = ["aab", "", "a-b.c", "---", "über42", "x9f8a7b6c5d4e3f2"]
    for got, want in zip(apply(spark, values, text.shannon_entropy), map(brute, values)):
        assert abs(got - want) < 1e-9


def test_private_addresses_match_the_standard_library(spark):
    rng = random.Random(5)
    values = ["10.1.2.3", "8.8.8.8", "192.0.0.9", "192.0.0.8", "100.64.0.1", "256.1.1.1", "01.2.3.4",
              "", "text", "1.2.3", "::1", "::", "fe80::1%eth0", "fc00::", "2001:db8::5", "2001:4:112::1",
              "2001:3::9", "64:ff9b:1::7", "64:ff9b::7", "2606:4700::1111", "::ffff:10.0.0.1",
              "::ffff:8.8.8.8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3", ":1:2", "12345::",
              "2002:1::", "100::1", "::1.2.3.4", "::1.2.3.400", "1:2:3:4:5:6:7:8:9", "fe80::1%"]
    values += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    values += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(50)]
    for block in ("172.16.0.0/12", "198.18.0.0/15", "240.0.0.0/4", "169.254.0.0/16"):
        net = ipaddress.ip_network(block)
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if n < 2**32:
                values.append(str(ipaddress.IPv4Address(n)))

    def brute(s):
        try:
            return ipaddress.ip_address(s).is_private
        except ValueError:
            return False

    got = apply(spark, values, network.is_private_ip)
    assert {v: g for v, g in zip(values, got)} == {v: brute(v) for v in values}


def test_traffic_direction(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", "8.8.8.8"), ("8.8.8.8", "10.0.0.1"), ("10.0.0.1", "192.168.1.1"),
         ("8.8.8.8", "1.1.1.1"), ("nonsense", None)], "a string, b string")
    got = [r[0] for r in df.select(network.traffic_direction(F.col("a"), F.col("b"))).collect()]
    assert got == ["Egress", "Ingress", "Lateral", "Internet-to-Internet", "Internet-to-Internet"]


def test_connection_state(spark):
    states = ["S0", "SF", "OTH", None]
    texts = apply(spark, states, network.conn_state_text)
    assert texts[0] == "Connection attempt, no reply"
    assert texts[2:] == ["Unknown State (OTH)", "Unknown State (None)"]
    marks = apply(spark, states, network.conn_assessment)
    assert [m.split(":")[0] for m in marks] == ["Suspicious"] + ["Informational"] * 3


def test_domain_parts(spark):
    hosts = ["a.b.example.co.uk", "Example.COM", "localhost", "8.8.8.8", "x.y.shop.xyz.",
             "http://user@www.site.org:80/p?q", "com.cn"]
    got = [tuple(r) for r in apply(spark, hosts, network.domain_parts)]
    assert got == [("a.b", "example", "co.uk"), ("", "Example", "COM"), ("", "localhost", ""),
                   ("", "8.8.8.8", ""), ("x.y", "shop", "xyz"), ("www", "site", "org"),
                   ("", "", "com.cn")]
    rules = ["com", "*.ck", "!www.ck", "uk", "co.uk"]
    hosts = ["a.b.c.ck", "a.www.ck", "x.co.uk", "x.unknown"]
    got = [tuple(r) for r in apply(
        spark, hosts, lambda h: network.domain_parts(h, rules, exact=True))]
    assert got == [("a", "b", "c.ck"), ("a", "www", "ck"), ("", "x", "co.uk"),
                   ("x", "unknown", "")]


def test_domain_parts_by_a_table_of_rules(spark):
    hosts = ["a.shop.com.pl", "com.pl", "x.y.foo.ck", "a.www.ck", "ck", "a.b.nowhere", "8.8.8.8", "localhost",
             "http://u@A.Example.CO.UK:80/p", "", None, "a.example.com", "a.example.com"]
    rows = spark.createDataFrame([(h, i) for i, h in enumerate(hosts)], "host string, i int")
    got = {r["i"]: r["parts"] and tuple(r["parts"]) for r in with_domain_parts(
        rows, "host", suffix_rules(spark)).collect()}
    assert [got[i] for i in range(len(hosts))] == [
        ("a", "shop", "com.pl"), ("", "", "com.pl"), ("x", "y", "foo.ck"), ("a", "www", "ck"), ("", "ck", ""),
        ("a.b", "nowhere", ""), ("", "8.8.8.8", ""), ("", "localhost", ""), ("A", "Example", "CO.UK"), ("", "", ""),
        None, ("a", "example", "com"), ("a", "example", "com")]


def test_suffix_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("// comment\n\ncom\n*.ck\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\nblogspot.com\n")
    assert [r["rule"] for r in suffix_rules(spark, str(path)).collect()] == ["com", "*.ck", "!www.ck"]
    none = with_domain_parts(spark.createDataFrame([("a.com",)], "host string"), "host",
                             spark.createDataFrame([], "rule string"))
    assert tuple(none.first()["parts"]) == ("a", "com", "")


def test_file_extension_matches_the_standard_library(spark):
    values = ["a.EXE", ".exe", "..a.exe", "dir.x/file", "a.b.tar.gz", "noext", "", "d/.hid", "a."]
    assert apply(spark, values, text.file_extension) == [
        os.path.splitext(v)[1].lower() for v in values]


def test_ports_normalise(spark):
    assert apply(spark, ["54066", "54066.0", "http", None, "nan"], text.normal_port) == [
        "54066", "54066", "http", None, "nan"]


def test_response_object(spark):
    values = ['x ```json\n{"a": 1}\n``` y', 'so {"a": 2} it is', '[1, {"a": 3}]', "42", "[]",
              "[1, 2]", "{broken", None]
    got = apply(spark, values, lambda c: F.to_json(jsontext.response_object(c)))
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', None, None, None, None, None]


def test_event_time(spark):
    values = ['{"timestamp": "2024-05-01T00:00:01.500000+0000"}', '{"timestamp": "2024-05-01T00:00:00Z"}',
              '{"timestamp": "soon"}', "{}", "not json", None]
    got = apply(spark, values, text.event_micros)
    assert got == [1714521601500000, 1714521600000000, None, None, None, None]


def test_reputation(spark):
    values = ["www.google.com", "ads.x.example", "cdn.y.example", "plain.example", "", None]
    assert apply(spark, values, network.sni_reputation) == [
        "Trusted Provider", "Adware/Tracker", "Likely Benign Infrastructure",
        "Unknown Reputation", "Unknown", "Unknown"]


def test_agent_properties(spark):
    got = apply(spark, ["curl/8", "MSIE 7.0 svchost.exe", "Mozilla/5"], text.agent_properties)
    assert got == [["Scripting/Tool Signature"],
                   ["Anomalous Pattern", "Outdated Browser Signature"], ["Normal"]]


def test_content_patterns_match_the_ones_of_python(spark):
    rng = random.Random(3)
    pieces = ["pa\u017f\u017fword", "union\xa0select", "union\x1cselect", "' or 1=1", "'\u2003and x = y",
              "sleep (", "onload\u3000=", "<\u017fcript", "<img", "=\xa0id", "=ls", "/uploads/\r\u2028shell.php",
              "/upload/\nshell.php", "a" * 31, "0f" * 16, "--", "*/", "plain", "\n", " ", "../", "KEY"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    df = df.withColumn("y", text.folded(F.lower("x")))
    got = {r["i"]: r["m"] for r in df.select(
        "i", text.mask_reasons(text.content_mask("y", True)).alias("m")).collect()}
    for i, v in enumerate(values):
        low = v.lower()
        want = [r for r, p in K.CONTENT_PATTERNS.items() if re.search(p, low, re.IGNORECASE)]
        if any(m in low for m in K.TRAVERSAL_MARKS):
            want.append(K.TRAVERSAL_REASON)
        assert got[i] == sorted(want), repr(v)
