"""Column contracts: input schemas, renames per vintage, outputs."""

from __future__ import annotations

# The column names of the two trade-file vintages.
TRADE_RENAMES = {
    "Delivery Start": "delivery_start",
    "DeliveryStart": "delivery_start",
    "Delivery End": "delivery_end",
    "DeliveryEnd": "delivery_end",
    "Execution time": "exec_ts",
    "ExecutionTime": "exec_ts",
    "TradeID": "trade_id",
    "TradeId": "trade_id",
    "Is Self Trade": "self_trade",
    "SelfTrade": "self_trade",
    "TradePhase": "trade_phase",
    "Side": "side",
    "Price": "price",
    "Quantity (MW)": "qty_mw",
    "Volume": "qty_mw",
}
TRADE_TIMES = ["delivery_start", "delivery_end", "exec_ts"]
TRADE_TYPES = {"trade_id": "long", "price": "double", "qty_mw": "double"}
TRADE_COLUMNS = [
    "trade_id", "exec_ts", "delivery_start", "delivery_end", "trade_phase", "self_trade",
    "side", "price", "qty_mw",
]

CONTRACT_STATS = (
    "contracts array<struct<isLocalContract:boolean,deliveryStart:string,deliveryEnd:string,"
    "contractOpenTime:string,contractCloseTime:string,highPrice:double,lowPrice:double,"
    "averagePrice:double,averagePriceLast3H:double,averagePriceLast1H:double,openPrice:double,"
    "closePrice:double,buyVolume:double,sellVolume:double,volume:double>>"
)
AREA_VOLUMES = (
    "multiAreaEntries array<struct<deliveryStart:string,deliveryEnd:string,"
    "entryPerArea:map<string,struct<buy:double,sell:double>>>>"
)

PARAMS = (
    "date date, hour int, which_hour_before int, method string, calibration_ok boolean, "
    "error string, df double, n long, p int, feature_names array<string>, "
    "mu_scaled array<double>, Sigma_scaled array<array<double>>, "
    "S_sample_scaled array<array<double>>, scaler_mean array<double>, scaler_scale array<double>, "
    "converged boolean, rounds int"
)
