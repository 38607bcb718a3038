import hashlib
import json

from ledgerline.operators import canonical


def leaves(value, path=""):
    if isinstance(value, dict):
        kept = {k: v for k, v in value.items() if not (k == "id" or k.endswith("_id") or k.endswith("_ids"))}
        if not value:
            yield path, "{}"
        for k, v in kept.items():
            yield from leaves(v, path + "/" + k.replace("~", "~0").replace("/", "~1"))
    elif isinstance(value, list):
        if not value:
            yield path, "[]"
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}/[{i}]")
    elif value is None:
        yield path, "null"
    elif isinstance(value, bool):
        yield path, "b:" + json.dumps(value)
    elif isinstance(value, str):
        yield path, "s:" + value
    else:
        yield path, "n:" + str(float(value))


PAYLOADS = [
    {"id": 1, "b": [1, 2.5, {"x_id": 3, "y": None, "z": {"q_ids": [1], "deep": [[], {}, [True, "é\n\"/"]]}}], "a": "text", "paid": 4},
    {"a": "text", "b": [1.0, 2.50, {"y": None, "z": {"deep": [[], {}, [True, "é\n\"/"]]}}], "paid": 4, "other_id": {"deep": 1}},
    {"a/b": 1, "c~d": "s", "n": -12, "f": False},
    {}, [], "only", 7, None, {"id": 5},
]


def test_hashes_equal_a_walk_in_python(spark):
    rows = [(i, json.dumps(p)) for i, p in enumerate(PAYLOADS)] + [(90, None), (91, "{broken"), (92, '{ "paid":4,"a" : "text",  "b":[1,2.5,{"y":null,"z":{"deep":[[],{},[true,"\\u00e9\\n\\"\\/"]]}}]}')]
    got = {r["k"]: r["content_hash"] for r in canonical.content_hashes(spark.createDataFrame(rows, "k int, payload string"), ["k"]).collect()}
    want = {i: hashlib.sha256("\n".join(sorted(f"{p}={v}" for p, v in leaves(payload))).encode()).hexdigest() for i, payload in enumerate(PAYLOADS)}
    assert {k: got[k] for k in want} == want
    assert got[0] == got[1] == got[92] and got[90] == got[91] != got[7] and len(got) == 12
