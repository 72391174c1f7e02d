"""shapelab.plans"""
