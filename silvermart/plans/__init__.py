"""The layers as plans over DataFrames."""
