from clickflow.functions.exprs import (  # noqa: F401
    MICROS_PER_MINUTE,
    array_lookup,
    flag,
    literal_regex,
    minutes_between,
    money_mean,
    money_sum,
    regex_extract,
    regex_extract_int,
    safe_divide,
)
