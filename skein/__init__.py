"""skein: DataFrame operators for time-stamped conversation data and text corpora."""
