"""quern: preparing and analysing language-model training data with ordinary DataFrames."""
