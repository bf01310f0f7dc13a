"""speechstats.sources"""
