"""Display texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Display texts.
COMPLIANCE_LABELS = {
    "good": "🟢 กำลังชั่งขยะติดเชื้อ",
    "medium": "🟡 ยอดแล้ววันนี้",
    "high": "🩷 ยังไม่ยอดขยะภายใน 24 ชม.",
    "offline": "⚫ ไม่ยอดขยะเกิน 48 ชม.",
    "none": "— ยังไม่เคยมีข้อมูล",
}
ALERT_TYPE_LABELS = {
    "bin_full": "น้ำหนักเกินขีด",
    "sensor_fault": "แบตเตอรี่ต่ำ",
    "unusual_activity": "อุณหภูมิสูง",
    "maintenance": "บำรุงรักษา",
}
RELATIVE_LABELS = {
    "now": "เมื่อสักครู่",
    "minute": " นาทีที่แล้ว",
    "hour": " ชม.ที่แล้ว",
    "day": " วันที่แล้ว",
}
EXPORT_HEADERS = {
    "timestamp": "วันที่/เวลา",
    "bin_code": "รหัสเครื่อง",
    "department": "หน่วยงาน",
    "weight_kg": "น้ำหนัก (กก.)",
    "battery_level": "แบตเตอรี่ (%)",
    "signal_strength": "สัญญาณ (dBm)",
    "temperature_c": "อุณหภูมิ (°C)",
}
KILOGRAMS = " กก."
WEIGHING_NOW = "กำลังชั่ง..."
WEIGHED = "⚖️ "
TODAY = "วันนี้ "
LATEST = "ล่าสุด "
NO_VALUE = "--"
ELLIPSIS = "…"
LABEL_WIDTH = 14


def mapped(code: Column, labels: dict[str, str], default: Column) -> Column:
    """``labels[code]`` as a CASE over literals."""
    chain = None
    for key, text in labels.items():
        chain = F.when(code == key, text) if chain is None else chain.when(code == key, text)
    return chain.otherwise(default)


def compliance_label(cls: Column) -> Column:
    return mapped(cls, COMPLIANCE_LABELS, cls)


def alert_type_label(alert_type: Column) -> Column:
    """Known types by table, others with spaces for underscores."""
    return mapped(alert_type, ALERT_TYPE_LABELS, F.replace(alert_type, F.lit("_"), F.lit(" ")))


def relative_label(unit: Column, count: Column) -> Column:
    text = mapped(unit, RELATIVE_LABELS, F.lit(None).cast("string"))
    return F.when(unit == "now", text).otherwise(F.concat(count.cast("string"), text))


def place_name(location: Column, bin_code: Column) -> Column:
    """The location, or the bin code where there is none."""
    return F.coalesce(F.nullif(location, F.lit("")), bin_code)


def chart_label(location: Column, bin_code: Column) -> Column:
    name = place_name(location, bin_code)
    cut = F.concat(F.substring(name, 1, LABEL_WIDTH - 1), F.lit(ELLIPSIS))
    return F.when(F.length(name) > LABEL_WIDTH, cut).otherwise(name)


def fixed_text(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals."""
    return value.cast(f"decimal(18,{digits})").cast("string")


def kilograms(value: Column) -> Column:
    return F.concat(fixed_text(value, 2), F.lit(KILOGRAMS))


def card_sub_text(cls: Column, weight: Column, total_today: Column) -> Column:
    """Weighing now: last weight; else today's total when positive; else last weight."""
    last = kilograms(weight)
    return (F.when(cls == "good",
                   F.coalesce(F.concat(F.lit(WEIGHED), last), F.lit(WEIGHING_NOW)))
            .when(total_today > 0, F.concat(F.lit(TODAY), kilograms(total_today)))
            .when(weight.isNotNull(), F.concat(F.lit(LATEST), last))
            .otherwise(""))
