"""Rule tables as data."""

#: (topic, pattern over folded text). Fixed values.
TOPIC_RULES = [
    ("legal", "license|copyright"),
    ("contact", "@|phone"),
    ("figures", "[0-9]{4,}"),
    ("assembly", "tion"),
    ("housing", "heit|keit"),
]
