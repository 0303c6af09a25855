"""scanloom.sinks"""
