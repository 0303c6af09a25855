"""scanloom.plans"""
