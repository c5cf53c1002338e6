"""isobarn.functions"""
