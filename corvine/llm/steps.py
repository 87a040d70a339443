"""A step of the tagger's LSTM as an ONNX graph, which onnxruntime runs with fused gates; the model is written in protobuf's wire format."""

from __future__ import annotations

import numpy as np

FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _node(op: str, inputs: str, outputs: str, **attributes: int) -> bytes:
    named = (_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in attributes.items())
    return b"".join((*(_field(1, x) for x in inputs.split()), *(_field(2, x) for x in outputs.split()), _field(4, op), *named))


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in a.shape) + _field(2, FLOAT) + _field(8, name) + _field(9, a.tobytes())


def _value(name: str, kind: int, *shape: int | str) -> bytes:
    dims = b"".join(_field(1, _field(2 if isinstance(n, str) else 1, n)) for n in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))


def model(P: np.ndarray, U: np.ndarray, W: np.ndarray) -> bytes:
    """The graph (x, h, c) -> (h, c, e): classes and states (rows, hidden) to the next states and the emissions (tags, rows)."""
    hidden, tags = W.shape
    nodes, constants = [], {"W": W.T}
    for k, (gate, kind) in enumerate(zip("ifoz", ("Sigmoid", "Sigmoid", "Sigmoid", "Tanh"))):
        constants |= {f"P{gate}": P[:, k * hidden : (k + 1) * hidden], f"U{gate}": U[:, k * hidden : (k + 1) * hidden]}
        nodes += [_node("Gather", f"P{gate} x", f"p{gate}", axis=0), _node("Gemm", f"h U{gate} p{gate}", f"g{gate}"), _node(kind, f"g{gate}", gate)]
    nodes += [
        _node("Mul", "i z", "iz"), _node("Mul", "f c", "fc"), _node("Add", "fc iz", "c_next"),
        _node("Tanh", "c_next", "top"), _node("Mul", "o top", "h_next"), _node("Gemm", "W h_next", "e", transB=1),
    ]
    state = lambda name: _value(name, FLOAT, "rows", hidden)
    graph = [
        *(_field(1, n) for n in nodes), _field(2, "step"), *(_field(5, _tensor(k, a)) for k, a in constants.items()),
        *(_field(11, v) for v in (_value("x", INT64, "rows"), state("h"), state("c"))),
        *(_field(12, v) for v in (state("h_next"), state("c_next"), _value("e", FLOAT, tags, "rows"))),
    ]
    return _field(1, 8) + _field(7, b"".join(graph)) + _field(8, _field(1, "") + _field(2, 17))


def step(P: np.ndarray, U: np.ndarray, W: np.ndarray):
    """Function (classes, h, c) -> (h, c, emissions) of one direction on one thread; None without onnxruntime."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    options.enable_mem_pattern = False  # the number of rows changes from step to step
    run = onnxruntime.InferenceSession(model(P, U, W), options, providers=["CPUExecutionProvider"]).run
    return lambda x, h, c: run(None, {"x": x, "h": h, "c": c})
