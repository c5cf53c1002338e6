"""isobarn.plans"""
