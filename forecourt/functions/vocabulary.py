"""Field names, stages, edges and word lists of the data model."""

# Metadata fields that filter retrieval.
FILTER_FIELDS = ["brand", "prize", "powertrain_type", "vehicle_category_bottom", "design_style", "drive_type", "seat_layout", "autonomous_driving_level", "size", "family_friendliness", "comfort_level", "smartness", "energy_consumption_level"]

# Records.
PROFILE_FIELDS = ["phone_number", "name", "title", "age", "target_driver", "expertise", "family_size", "price_sensitivity", "residence", "parking_conditions"]
EXPLICIT_FIELDS = ["prize", "vehicle_category_bottom", "brand", "powertrain_type", "design_style", "drive_type", "seat_layout", "autonomous_driving_level", "ABS", "ESP", "airbag_count", "horsepower", "torque", "acceleration_0_100", "max_speed", "fuel_consumption", "electric_range", "battery_capacity", "cargo_volume", "wheelbase", "ground_clearance"]
IMPLICIT_FIELDS = ["size", "vehicle_usability", "aesthetics", "comfort_level", "smartness", "family_friendliness", "energy_consumption_level", "road_performance", "brand_grade", "driving_range", "power_performance", "safety", "cost_performance", "space", "cargo_space"]
RESERVATION_FIELDS = ["test_driver", "reservation_date", "reservation_time", "reservation_location", "reservation_phone_number", "salesman"]
KEY_NEEDS = ["prize", "brand", "powertrain_type", "vehicle_category_bottom", "design_style"]

# The funnel's stages in order, and allowed transitions.
STAGES = ["welcome", "profile_analysis", "needs_analysis", "car_selection_confirmation", "reservation4s", "reservation_confirmation", "farewell"]
EDGES = [
    ("welcome", "profile_analysis"),
    ("profile_analysis", "needs_analysis"),
    ("needs_analysis", "car_selection_confirmation"),
    ("car_selection_confirmation", "reservation4s"),
    ("car_selection_confirmation", "needs_analysis"),
    ("reservation4s", "reservation_confirmation"),
    ("reservation_confirmation", "farewell"),
    ("reservation_confirmation", "reservation4s"),
]

# Response scoring.
STAGE_WORDS = {
    "welcome": ["你好", "欢迎", "hello", "hi", "welcome", "请问", "what"],
    "profile_analysis": ["名字", "年龄", "家", "name", "age", "family", "请问", "who", "住"],
    "needs_analysis": ["预算", "品牌", "车型", "budget", "brand", "type", "偏好", "prefer", "需求"],
    "car_selection_confirmation": ["推荐", "recommend", "车型", "model", "试驾", "test drive", "对比", "compare"],
    "reservation4s": ["预约", "日期", "时间", "地点", "reservation", "date", "time", "location", "schedule"],
    "reservation_confirmation": ["确认", "confirm", "信息", "details", "预约", "reservation"],
    "farewell": ["感谢", "thank", "再见", "goodbye", "祝", "期待", "look forward"],
}
INVITING = ["请", "please", "您觉得", "what do you think"]
SLANG = ["lol", "haha", "lmao", "wtf", "omg", "shit", "damn"]
POLITE = ["您", "请", "感谢", "很高兴", "为您", "帮您", "please", "thank", "glad", "happy to", "help you", "would you"]

# Labels that don't apply to a powertrain.
ELECTRIC_LABELS = ["battery_capacity", "electric_consumption"]
COMBUSTION_LABELS = ["engine_displacement", "fuel_consumption", "fuel_tank_capacity"]
COMBUSTION_TYPES = ["Gasoline Engine", "Diesel Engine"]
ELECTRIC_TYPE = "Battery Electric Vehicle"
NONE_TEXT = "None"
