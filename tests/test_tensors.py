"""Tensor headers and expert parts on a small file."""

import json

import pytest

from moetrace.sources import tensors


def _file(entries):
    at, head = 0, {"__metadata__": {"format": "pt"}}
    for name, dtype, shape, n in entries:
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + n]}
        at += n
    raw = json.dumps(head).encode()
    return len(raw).to_bytes(8, "little") + raw


ENTRIES = [x for layer in (0, 1) for x in (
    (f"model.layers.{layer}.block_sparse_moe.input_linear.weight", "BF16", [3, 4, 8], 192),
    (f"model.layers.{layer}.block_sparse_moe.output_linear.weight", "BF16", [3, 4, 4], 96),
    (f"model.layers.{layer}.block_sparse_moe.router.layer.weight", "BF16", [3, 8], 48),
    (f"model.layers.{layer}.self_attn.q_proj.weight", "BF16", [4, 4], 32),
)] + [("model.embed_tokens.weight", "BF16", [8, 8], 128), ("model.layers.0.mlp.experts.gate_up_proj", "BF16", [3, 2, 2], 24)]


def _read(spark, *contents):
    return tensors.parse_headers(spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary"))


def test_parts(spark):
    found = _read(spark, _file(ENTRIES))
    assert found.count() == len(ENTRIES)
    got = {(r["layer"], r["expert"], r["projection"]): (r["offset"], r["len"]) for r in tensors.expert_parts(found).collect()}
    want = {(la, e, f"{p}.weight"): (e * n, n) for la in (0, 1) for e in range(3) for p, n in (("input_linear", 64), ("output_linear", 32))}
    want.update({(0, e, "gate_up_proj"): (e * 8, 8) for e in range(3)})
    assert got == want


@pytest.mark.parametrize("content", [b"", b"\x05\0\0\0\0\0\0\0{", _file([("a", "BF16", [2, 2], 16)])])
def test_broken_files_fail(spark, content):
    with pytest.raises(Exception, match="broken tensor header|do not fit"):
        _read(spark, content).collect()


def test_mixed_layers_fail(spark):
    mixed = [("model.layers.0.mlp.experts.a", "BF16", [3, 2], 12), ("model.layers.0.mlp.experts.b", "BF16", [2, 2], 8)]
    with pytest.raises(Exception, match="mixed tensors"):
        tensors.expert_parts(_read(spark, _file(mixed))).collect()
