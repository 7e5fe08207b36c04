"""Message types that come with the package."""

from __future__ import annotations

from ferryline.operators.protobuf import ProtoRegistry, ProtoType, describe

# Field, number, type of each message, and the values of each enum.
SENSOR = {
    "Location": [("x", 1, "int32"), ("y", 2, "int32")],
    "Event": [("name", 1, "string"), ("value", 2, "int32")],
    "Sensor": [
        ("name", 1, "string"),
        ("temperature", 2, "double"),
        ("humidity", 3, "int32"),
        ("door", 5, "SwitchLevel"),
        ("location", 6, "Location"),
        ("event", 7, "Event"),
    ],
}
SENSOR_ENUMS = {"SwitchLevel": {"CLOSED": 0, "OPEN": 1}}
VIDEO_AD = {
    "VideoAd": [
        ("timestamp", 1, "uint64"),
        ("randomId", 2, "uint64"),
        ("impressionId", 3, "string"),
        ("requestId", 4, "string"),
        ("abTestId", 5, "uint32"),
        ("zoneId", 6, "uint32"),
        ("userId", 7, "uint32"),
        ("clicked", 8, "bool"),
    ],
}


def bundled() -> ProtoRegistry:
    registry = ProtoRegistry()
    registry.add("Sensor", ProtoType(describe("sensors", SENSOR, SENSOR_ENUMS), "sensors.Sensor"))
    registry.add("VideoAd", ProtoType(describe("ads", VIDEO_AD), "ads.VideoAd"))
    return registry
