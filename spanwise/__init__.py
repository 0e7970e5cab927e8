"""Analytics over timed rows (segments, candidates, clips, cues) on Spark DataFrames."""
