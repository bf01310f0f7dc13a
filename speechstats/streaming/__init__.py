"""speechstats.streaming"""
