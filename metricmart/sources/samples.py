"""Small OTLP/JSON export requests (A8), used by tests and examples.

Builders return plain dicts in the OTLP/JSON shape; ``requests_from_json``
turns a list of them into a request DataFrame.
"""

from __future__ import annotations

# The sample request's names and attributes.
SAMPLE_SERVICE = "my-test-service"
SAMPLE_HOST = "local"
SAMPLE_SCOPE = ("sample-scope", "0.0.1")

NOW = 1_700_000_000_000_000_000  # nanoseconds, 2023-11-14T22:13:20Z


def s(v: str) -> dict:
    return {"stringValue": v}


def i(v: int) -> dict:
    return {"intValue": str(v)}


def kv(key: str, value: dict | None) -> dict:
    return {"key": key} if value is None else {"key": key, "value": value}


def point(t: int = NOW, value: float | int | None = None, attrs: list | None = None,
          start: int | None = None, flags: int | None = None) -> dict:
    p: dict = {"timeUnixNano": str(t)}
    if start is not None:
        p["startTimeUnixNano"] = str(start)
    if isinstance(value, bool):
        raise TypeError("bool is not a point value")
    if isinstance(value, int):
        p["asInt"] = str(value)
    elif isinstance(value, float):
        p["asDouble"] = value
    if attrs is not None:
        p["attributes"] = attrs
    if flags is not None:
        p["flags"] = flags
    return p


def gauge(name: str, points: list, description: str = "", unit: str = "") -> dict:
    return {"name": name, "description": description, "unit": unit,
            "gauge": {"dataPoints": points}}


def sum_metric(name: str, points: list, temporality: int = 2, monotonic: bool = True,
               description: str = "", unit: str = "") -> dict:
    return {"name": name, "description": description, "unit": unit,
            "sum": {"aggregationTemporality": temporality, "isMonotonic": monotonic,
                    "dataPoints": points}}


def histogram(name: str, t: int = NOW, count: int = 10, total: float = 100.0) -> dict:
    return {"name": name, "histogram": {"aggregationTemporality": 2, "dataPoints": [
        {"timeUnixNano": str(t), "count": str(count), "sum": total}]}}


def request(metrics: list, resource_attrs: list | None = None, scope: tuple | None = None,
            scope_attrs: list | None = None, seq: int = 1, resource: bool = True) -> dict:
    sm: dict = {"metrics": metrics}
    if scope is not None or scope_attrs is not None:
        sc: dict = {}
        if scope is not None:
            sc["name"], sc["version"] = scope
        if scope_attrs is not None:
            sc["attributes"] = scope_attrs
        sm["scope"] = sc
    rm: dict = {"scopeMetrics": [sm]}
    if resource:
        rm["resource"] = {"attributes": resource_attrs or []}
    return {"request_seq": seq, "request_part": 0, "resourceMetrics": [rm]}


def sample_request(seq: int = 1, t: int = NOW) -> dict:
    """One gauge (cpu.utilization 42.5) and one sum (requests.total, int 1234)."""
    return request(
        [gauge("cpu.utilization", [point(t, 42.5, [kv("cpu", i(0))])], "CPU utilization", "1"),
         sum_metric("requests.total", [point(t, 1234, [kv("method", s("GET")),
                                                       kv("status", i(200))])],
                    description="Total requests", unit="{request}")],
        resource_attrs=[kv("service.name", s(SAMPLE_SERVICE)), kv("host.name", s(SAMPLE_HOST))],
        scope=SAMPLE_SCOPE, seq=seq)
