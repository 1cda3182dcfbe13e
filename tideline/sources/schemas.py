"""Declared schemas of the inputs."""

KLINES_RAW = "open_time BIGINT, open STRING, high STRING, low STRING, close STRING, volume STRING, close_time BIGINT, quote_volume STRING, trades BIGINT, taker_buy_base STRING, taker_buy_quote STRING, ignore STRING"
BARS = "symbol STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
BARS_EXTENDED = BARS + ", quote_volume DOUBLE, trades BIGINT"
TAPE = "symbol STRING, ts TIMESTAMP_NTZ, trade_id BIGINT, price DOUBLE, quantity DOUBLE, is_buyer_maker BOOLEAN"
FUNDING = "fundingTime TIMESTAMP_NTZ, fundingRate DOUBLE, markPrice DOUBLE"
OPEN_INTEREST = "create_time TIMESTAMP_NTZ, sum_open_interest DOUBLE, sum_open_interest_value DOUBLE, count_toptrader_long_short_ratio DOUBLE, sum_toptrader_long_short_ratio DOUBLE, count_long_short_ratio DOUBLE, sum_taker_long_short_vol_ratio DOUBLE"
ALERT = "symbol STRING, timestamp STRING, action STRING, probability DOUBLE, close_price DOUBLE, horizon_bars INT"
