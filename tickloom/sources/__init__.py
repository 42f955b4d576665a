"""Where trades come from: captured messages as files or streams, and tables that stand in for feeds."""
